"""Language identification by error-correcting output codes.

Every language has a codeword; one binary classifier per bit predicts it from character n-grams (hashed, one to three
characters, square roots of shares). Decoding takes the language whose codeword has the smallest loss, each bit
weighted by what it got right in training. The classifiers are fitted together by ridge regression on the driver from
a sample of labelled documents whose size is bounded by `Languages.sample`; prediction is one pass over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from freightlens.llm.tables import BATCH_CHARS, shared, text_slices
from freightlens.llm.text_codes import letter_tables, normalise

UNKNOWN = "und"


@dataclass(frozen=True)
class Languages:
    """sample: expected number of labelled rows used for fitting, shared evenly by the languages. features: hashed
    n-gram buckets. bits: bits of a codeword at least. ridge: strength of the penalty. margin: a prediction is ambiguous
    if its score leads the next by less."""

    sample: int = 6_000
    features: int = 2_048
    bits: int = 15
    ridge: float = 1e-3
    margin: float = 0.05


@dataclass
class CodeModel:
    """names: languages. code: +1 or -1 by language and bit. weights: features and a constant by bit. trust: by bit."""

    names: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray


def codewords(count: int, bits: int) -> np.ndarray:
    """`count` rows of +1 and -1 that are far apart: the best of seeded draws by smallest distance, then the sum."""
    bits = max(bits, 2 * int(np.ceil(4 * np.log2(max(count, 2)))))
    best, rank = None, None
    for seed in range(200 if count < 100 else 5):
        drawn = np.random.default_rng(seed).integers(0, 2, (count, bits)) * 2 - 1
        constant = np.abs(drawn.sum(0)) == count
        drawn[0, constant] *= -1
        apart = (bits - drawn @ drawn.T) // 2
        away = apart[np.triu_indices(count, 1)]
        got = (int(away.min()), int(away.sum())) if len(away) else (0, 0)
        if rank is None or got > rank:
            best, rank = drawn, got
    return best


def n_gram_shares(texts: list[str | None], features: int, tables) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of texts, and which texts have a letter. Only letters count; all else is one blank."""
    parts = [normalise(t or "", tables)[0] for t in texts]
    lettered = np.array([len(p) > 0 for p in parts], bool)
    blank = np.array([32], np.uint32)
    joined = np.concatenate([x for p in parts for x in (blank, p)] + [blank]).astype(np.uint64)
    owner = np.repeat(np.arange(len(parts)), [len(p) + 1 for p in parts])
    counts = np.zeros(len(parts) * features)
    gram = np.zeros(len(joined), np.uint64)
    for n in range(1, 4):
        size = len(joined) - n + 1
        gram = gram[:size] * np.uint64(0x9E3779B97F4A7C15) + joined[n - 1 :] + np.uint64(n)
        bucket = ((gram * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)) % np.uint64(features)
        size = min(size, len(owner))
        counts += np.bincount(owner[:size] * features + bucket[:size].astype(np.int64), minlength=len(counts))
    shares = counts.reshape(len(parts), features)
    return np.sqrt(shares / np.maximum(shares.sum(1, keepdims=True), 1)), lettered


def _with_constant(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def fit(docs: DataFrame, plan: Languages = Languages(), key: str = "doc_id", text: str = "text", lang: str = "lang") -> CodeModel:
    """Learn from rows of `docs` with a text and a language. The sample is chosen by a hash of the key, so that each
    language gives an equal number or all its rows; no rows give a model that knows no language."""
    known = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    names = sorted(n for n in counts if n != UNKNOWN)
    if not names:
        return CodeModel([], np.zeros((0, 0)), np.zeros((plan.features + 1, 0)), np.zeros(0))
    each = plan.sample / len(names)
    draw = F.pmod(F.xxhash64("key", F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    rate = F.create_map(*[F.lit(v) for n in names for v in (n, min(1.0, each / counts[n]))])
    chosen = known.where(F.col("lang").isin(names) & (draw < rate[F.col("lang")]))
    schema = "lang string, key long, x binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = letter_tables("isalpha")
        for batch in batches:
            for first, texts in text_slices(batch, 2):
                x, lettered = n_gram_shares(texts, plan.features, tables)
                keep = np.flatnonzero(lettered)
                if len(keep):
                    part = batch.slice(first, len(texts))
                    yield pa.record_batch([part.column(0).take(pa.array(keep)), part.column(1).take(pa.array(keep)),
                                           pa.array([x[i].astype("<f2").tobytes() for i in keep], pa.binary())], ["lang", "key", "x"])

    rows = chosen.select("lang", F.xxhash64("key", "text").alias("key"), "text").mapInArrow(run, schema).sort("key", "lang").collect()
    names = sorted({r["lang"] for r in rows})
    if not names:
        return CodeModel([], np.zeros((0, 0)), np.zeros((plan.features + 1, 0)), np.zeros(0))
    code, place = codewords(len(names), plan.bits), {n: i for i, n in enumerate(names)}

    def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The sample a few hundred rows at a time, so that the driver never holds it as one matrix."""
        for first in range(0, len(rows), 500):
            some = rows[first : first + 500]
            x = np.frombuffer(b"".join(r["x"] for r in some), "<f2").reshape(len(some), plan.features)
            yield _with_constant(x.astype(np.float64)), code[[place[r["lang"]] for r in some]].astype(np.float64)

    squares, products = plan.ridge * len(rows) * np.eye(plan.features + 1) / plan.features, np.zeros((plan.features + 1, code.shape[1]))
    for x, y in parts():
        squares += x.T @ x
        products += x.T @ y
    weights = np.linalg.solve(squares, products)
    right = sum(((x @ weights > 0) == (y > 0)).sum(0) for x, y in parts()) / len(rows)
    return CodeModel(names, code, weights, np.maximum(2 * right - 1, 0.01))


def decode(model: CodeModel, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its score and its lead over the next, by squared hinge loss weighted by bit."""
    margins = np.clip(_with_constant(x) @ model.weights, -2, 2)
    loss = np.square(np.maximum(0, 1 - margins[:, None, :] * model.code[None])) @ model.trust / model.trust.sum()
    odds = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
    odds /= odds.sum(1, keepdims=True)
    ranked = np.sort(odds, 1)
    lead = ranked[:, -1] - ranked[:, -2] if odds.shape[1] > 1 else np.ones(len(odds))
    return odds.argmax(1), ranked[:, -1], lead


PREDICTED = "lang_pred string, score double, ambiguous boolean"


def predict(docs: DataFrame, model: CodeModel, plan: Languages = Languages(), text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of `docs` (default: all but the text) with lang_pred, score (0 to 1) and ambiguous.

    A NULL text or one without a letter is `und` with score 0 and not ambiguous; so is every text if the model knows no
    language. Rows are never added or dropped. Columns called like a result are replaced by it.
    """
    names = PREDICTED.replace(",", "").split()[::2]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names and (keep is not None or c != text)]
    frame = docs.select(*kept, F.col(text).alias("_text"))
    schema = StructType([*docs.select(*kept).schema, *docs.sparkSession.createDataFrame([], PREDICTED).schema])
    sent = shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, known = letter_tables("isalpha"), sent.value
        for batch in batches:
            for first, texts in text_slices(batch, len(kept), BATCH_CHARS // 2):
                lang, score, ambiguous = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
                x, lettered = n_gram_shares(texts, plan.features, tables)
                rows = np.flatnonzero(lettered) if known.names else []
                if len(rows):
                    best, top, lead = decode(known, x[rows])
                    score[rows], ambiguous[rows] = top, lead < plan.margin
                    for row, name in zip(rows, best):
                        lang[row] = known.names[name]
                part = batch.slice(first, len(texts))
                yield pa.record_batch([*part.columns[:-1], pa.array(lang), pa.array(score), pa.array(ambiguous)], schema.fieldNames())

    return frame.mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    """Documents never learned from: crc32 of the key as text leaves no remainder by 5."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def learn(spark: SparkSession, docs: DataFrame, plan: Languages = Languages()) -> CodeModel:
    """Fit on the documents that are not held out (rows without a key are held out too)."""
    return fit(docs.where(~F.coalesce(held_out(), F.lit(True))), plan)


def known_only(docs: DataFrame, model: CodeModel, plan: Languages = Languages(), text: str = "text") -> DataFrame:
    """`docs`, all columns, without rows that are `und` or ambiguous. Filters in place: no shuffle, no key needed."""
    sent, place = shared(docs.sparkSession, model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, known = letter_tables("isalpha"), sent.value
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for first, texts in text_slices(batch, place, BATCH_CHARS // 2):
                x, lettered = n_gram_shares(texts, plan.features, tables)
                rows = np.flatnonzero(lettered) if known.names else np.empty(0, int)
                if len(rows):
                    keep[first + rows] = decode(known, x[rows])[2] >= plan.margin
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
