"""Best-fit packing of token pieces into sequences, after a Martello-Toth dominance reduction.

A packing depends on piece lengths alone, and there are at most `capacity` different ones. So the reduction and the
best-fit run over a histogram of lengths, equal steps taken many at once, and give a short list of patterns, each used by
a number of sequences. Pieces then find their places by their rank among the pieces of their length. What reaches the
driver and what is broadcast is bounded by the capacity, whatever the number of documents.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame, functions as F

from freightlens.functions.ranks import row_ranks
from freightlens.llm.tables import BATCH_CHARS, text_slices

CAPACITY = 2_048
END_ID = 0
#: Each length is ranked in so many parts, so that a length that most pieces have does not end in one task.
RANK_PARTS = 128
#: Word forms that a task remembers the ids of; beyond that it starts anew.
MEMORY = 250_000
#: A byte that stands between words in one call of the merges, and signs that may end a chunk (neither letters nor digits).
BETWEEN = "\x01"
SIGNS = "!\"#$%&()*+,-./:;<=>?@[]^_{|}~"


# ---- tokens ----

class Slots(dict):
    """Numbers for keys, given when a key is first asked for; `new` has the keys since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        self.new.append(key)
        return number


class Encoder:
    """Token ids of whole texts: those of `tokenizers`, remembered by blank-separated chunk where that is the same.

    The tokenizer normalises (NFC, blanks to one space, lower case by character) and splits into words before merging, and no
    word crosses a blank. For texts of Latin letters, digits and common signs, where normalising is lower-casing, each
    distinct chunk is encoded once. Any other text goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.merges = tokenizers.Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.merges.pre_tokenizer = tokenizers.pre_tokenizers.Sequence([
            tokenizers.pre_tokenizers.Split(BETWEEN, "isolated"), self.merges.pre_tokenizer])
        self.between = self.merges.encode(BETWEEN, add_special_tokens=False).ids
        self.plain = self._plain() if self._splits_as_expected() else None
        self.clear()

    def _splits_as_expected(self) -> bool:
        """Does the file's tokenizer split at blanks and between letters and signs? Else every text goes to it whole."""
        ids = lambda how, text: how.encode(text, add_special_tokens=False).ids
        probe = "Two words, a Third-one 12 it's\nété."
        parts = [i for chunk in probe.lower().split() for i in ids(self.tokenizer, chunk)]
        ended = ids(self.merges, "words") + ids(self.tokenizer, ",).") == ids(self.tokenizer, "Words,).")
        joined = ids(self.merges, f"words{BETWEEN}été") == [*ids(self.tokenizer, "Words"), *self.between, *ids(self.tokenizer, "Été")]
        return ids(self.tokenizer, probe) == parts and ended and joined and len(self.between) == 1 and not ids(self.tokenizer, " \n\t")

    @staticmethod
    def _plain() -> re.Pattern:
        """Texts of characters that NFC leaves alone and whose lower case is one character of the same kind."""
        chars = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA1, 0xAD), *range(0xAE, 0x250), *range(0x2010, 0x2028), 0x20AC]]
        good = [c for c in chars if unicodedata.normalize("NFC", c) == c and len(c.lower()) == 1 and unicodedata.normalize("NFC", c.lower()) == c.lower()]
        return re.compile("[" + "".join(map(re.escape, good)) + "]*")

    def clear(self) -> None:
        self.slots = Slots()
        self.first, self.count, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(8192, np.uint32), 0

    def _encode_new(self) -> None:
        """Encode chunks not seen before. A word of letters is one word to the tokenizer, so it goes to the merges at once, and
        many go in one call, with a byte between them that no word has. A word with signs behind it is the word's ids and the
        signs' ids, each made once. All else goes through the whole tokenizer."""
        chunks, start = self.slots.new, len(self.slots) - len(self.slots.new)
        stems = [c.rstrip(SIGNS) for c in chunks]
        ended = [i for i, (c, s) in enumerate(zip(chunks, stems)) if len(s) < len(c) and s.isalpha()]
        halves = [self.slots[h] for i in ended for h in (stems[i], chunks[i][len(stems[i]) :])]  # may add to the new ones
        words, rest = np.fromiter(map(str.isalpha, chunks), bool, len(chunks)), np.ones(len(chunks), bool)
        rest[words] = rest[ended] = False
        at = np.flatnonzero(words)
        letters = list(compress(chunks, words))
        for first in range(0, len(letters), 5_000):
            joined = BETWEEN.join(letters[first : first + 5_000])
            ids = np.array(self.merges.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(ids == self.between[0])
            sizes = np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1
            self._store(at[first : first + 5_000] + start, sizes, np.delete(ids, cuts))
        at, others = np.flatnonzero(rest), list(compress(chunks, rest))
        for first in range(0, len(others), 5_000):
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(others[first : first + 5_000], add_special_tokens=False)]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            self._store(at[first : first + 5_000] + start, sizes, np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())))
        if ended:
            halves = np.array(halves, np.int64)
            self._store(np.array(ended, np.int64) + start, self.count[halves].reshape(-1, 2).sum(axis=1), self._gather(halves))
        self.slots.new = []

    def _store(self, slots: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        new = self.used + len(ids)
        if len(self.slots) > len(self.first):
            self.first, self.count = (np.resize(x, 2 * len(self.slots)) for x in (self.first, self.count))
        if new > len(self.flat):
            self.flat = np.resize(self.flat, 2 * new)
        self.first[slots], self.count[slots] = self.used + np.cumsum(sizes) - sizes, sizes
        self.flat[self.used : new] = ids
        self.used = new

    def _gather(self, slots: np.ndarray) -> np.ndarray:
        """The ids of stored chunks, one behind the other."""
        sizes = self.count[slots]
        return self.flat[np.repeat(self.first[slots] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without special tokens added."""
        plain = [self.plain is not None and "<|" not in t and self.plain.fullmatch(t) is not None for t in texts]
        rest = [t for t, p in zip(texts, plain) if not p]
        others = iter(self.tokenizer.encode_batch_fast(rest, add_special_tokens=False) if rest else [])
        chunks = [t.lower().split() if p else [] for t, p in zip(texts, plain)]
        if len(self.slots) > MEMORY:
            self.clear()
        slots = np.fromiter(map(self.slots.__getitem__, chain.from_iterable(chunks)), np.int64, sum(map(len, chunks)))
        self._encode_new()
        ids = self._gather(slots)
        cuts = np.concatenate([[0], np.cumsum(self.count[slots])])[np.cumsum([0, *map(len, chunks)])]
        return [ids[a:b] if p else np.array(next(others).ids, np.uint32) for p, a, b in zip(plain, cuts[:-1], cuts[1:])]


def encoder_of(path: str) -> Encoder:
    """One encoder per worker process and file. Functions shipped by value get new globals in every task, so it is kept with
    the imported package."""
    kept = vars(tokenizers).setdefault("_kept_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    kept[path].clear()
    return kept[path]


PIECES = "piece int, start long, length long, ids_crc32 long, ids array<int>"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """Every document as pieces of at most `capacity` tokens: key, piece, start, length, ids_crc32 and (on wish) ids.

    A document is its ids and a closing id 0, so a NULL or empty text is one piece of one token. Only documents longer
    than the capacity are cut. Repeated rows give repeated pieces. `tokenizer` is the path of a tokenizer file on every machine.
    """
    kind = docs.select(key).schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, {PIECES}" if with_ids else f"`{key}` {kind}, {PIECES.rpartition(',')[0]}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for batch in batches:
            for first, texts in text_slices(batch, 1, BATCH_CHARS):
                rows, starts, sizes, crcs, ids = [], [], [], [], []
                for row, got in enumerate(encoder.encode([t or "" for t in texts]), first):
                    got = np.append(got, np.uint32(END_ID)).astype("<u4")
                    for start in range(0, len(got), capacity):
                        part = got[start : start + capacity]
                        rows.append(row)
                        starts.append(start)
                        sizes.append(len(part))
                        crcs.append(zlib.crc32(part.tobytes()))
                        ids.append(part)
                start = np.array(starts, np.int64)
                columns = [batch.column(0).take(pa.array(rows)), pa.array((start // capacity).astype(np.int32)), pa.array(start),
                           pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())]
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32))))
                yield pa.record_batch(columns, [key, *PIECES.replace(",", "").split()[: 2 * (len(columns) - 1) : 2]])
        encoder.clear()

    return docs.select(key, text).mapInArrow(run, schema)


# ---- the packing of a histogram ----

def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, tuple[tuple[int, int], ...]]], dict[int, int]]:
    """Martello-Toth dominance over a histogram: fixed patterns (sequences, ((length, pieces), ...)) and what is left.

    From the longest length down. A set that holds a piece dominates all other sets that hold it if what they add can
    be exchanged for what it adds without growing:
    - the piece alone, if nothing fits beside it;
    - with the longest piece that fits, if that fills the rest, or no two pieces fit beside it, or no three do and no two
      that fit are together longer.
    What holds for one piece holds for the next of its length while the partner lasts, so whole runs are fixed at once.
    """
    left = {w: n for w, n in counts.items() if n}
    order, fixed = sorted(left), []

    def remove(width: int, n: int) -> None:
        left[width] -= n
        if not left[width]:
            del left[width]
            order.pop(bisect_left(order, width))

    def smallest(n: int) -> int:
        total = 0
        for width in order[:n]:
            used = min(n, left[width])
            total, n = total + used * width, n - used
        return total if not n else capacity + 1

    def longest_two(room: int) -> int:
        best, low, high = 0, 0, bisect_left(order, room + 1) - 1
        while low < high or low == high and left[order[low]] > 1:
            if order[low] + order[high] > room:
                high -= 1
            else:
                best, low = max(best, order[low] + order[high]), low + 1
        return best

    for width in sorted(left, reverse=True):
        while number := left.get(width):
            room = capacity - width
            remove(width, 1)
            at = bisect_left(order, room + 1) - 1
            if at < 0:
                if number > 1:
                    remove(width, number - 1)
                fixed.append((number, ((width, 1),)))
                break
            partner = order[at]
            if partner == room or smallest(2) > room or smallest(3) > room and longest_two(room) <= partner:
                n = number // 2 if partner == width else min(number, left[partner])
                if partner == width:
                    remove(width, 2 * n - 1)
                    fixed.append((n, ((width, 2),)))
                else:
                    if n > 1:
                        remove(width, n - 1)
                    remove(partner, n)
                    fixed.append((n, ((width, 1), (partner, 1))))
                continue
            if number == 1:
                insort(order, width)
            left[width] = number
            break
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Best-fit decreasing over a histogram: patterns (sequences, ((length, pieces), ...)).

    Sequences with the same content are one group. A piece goes to the fullest sequence that has room; the next of its
    length goes to the same one while it still has room, so a group takes its pieces in one step and splits once at most.
    """
    groups: list[tuple[int, int, tuple]] = []  # (room, sequences, content), by room

    def put(room: int, sequences: int, content: tuple) -> None:
        if sequences:
            insort(groups, (room, sequences, content))

    for width in sorted(counts, reverse=True):
        number = counts[width]
        at = bisect_left(groups, (width,))
        changed = []
        while number and at < len(groups):
            room, sequences, content = groups.pop(at)
            each = room // width
            full = min(sequences, number // each)
            changed.append((room - each * width, full, content + ((width, each),)))
            number -= full * each
            if full < sequences:
                rest = sequences - full
                if number:
                    changed.append((room - number * width, 1, content + ((width, number),)))
                    rest, number = rest - 1, 0
                changed.append((room, rest, content))
        if number:
            each = capacity // width
            changed.append((capacity - each * width, number // each, ((width, each),)))
            if number % each:
                changed.append((capacity - number % each * width, 1, ((width, number % each),)))
        for group in changed:
            put(*group)
    return [(n, content) for _, n, content in groups]


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """The whole packing: fixed sets, then best-fit over the rest."""
    if counts and not 0 < min(counts) <= max(counts) <= capacity:
        raise ValueError("lengths must lie between 1 and the capacity")
    fixed, left = reduce_instance(counts, capacity)
    return fixed + best_fit(left, capacity)


SLOTS = "length long, low long, high long, base long, each long, at long"


def slot_table(patterns: list[tuple[int, tuple[tuple[int, int], ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """For each length, which ranks go where: ranks low..high-1 fill sequences from `base`, `each` per sequence, the
    first at offset `at`."""
    used: dict[int, int] = {}
    rows, base = [], 0
    merged: dict[tuple, int] = {}
    for sequences, content in patterns:
        merged[content] = merged.get(content, 0) + sequences
    for content, sequences in merged.items():
        at = 0
        for width, each in content:
            low = used.get(width, 0)
            used[width] = low + sequences * each
            rows.append((width, low, used[width], base, each, at))
            at += width * each
        base += sequences
    return rows


def place(frame: DataFrame, keys: list[str], capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """Add sequence_id and offset to rows with a length; `keys` order equal lengths. `frame` is read three times, so
    pass a staged table. No rows give no rows."""
    spark = frame.sparkSession
    counts = {r["w"]: r["n"] for r in frame.groupBy(F.col(length).cast("long").alias("w")).agg(F.count("*").alias("n")).collect()}
    slots = spark.createDataFrame(slot_table(pack_histogram(counts, capacity)), SLOTS)
    part = F.pmod(F.xxhash64(*keys), F.lit(RANK_PARTS))
    ranked = row_ranks(frame, [length], part, [F.col(k) for k in keys], "_rank").alias("r")
    slots = F.broadcast(slots.withColumnRenamed("length", "_w")).alias("s")  # one row for each length and pattern: bounded by the capacity
    fits = (F.col(f"r.{length}") == F.col("s._w")) & (F.col("_rank") >= F.col("s.low")) & (F.col("_rank") < F.col("s.high"))
    inside = F.col("_rank") - F.col("s.low")
    return ranked.join(slots, fits).select(
        *[F.col(f"r.`{c}`") for c in frame.columns],
        (F.col("s.base") + F.floor(inside / F.col("s.each"))).cast("long").alias("sequence_id"),
        (F.col("s.at") + F.pmod(inside, F.col("s.each")) * F.col(f"r.{length}")).cast("long").alias("offset"))


def sequences(tokens: DataFrame, placed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and the lengths of the pieces in order (their boundaries).
    Needs pieces with ids and unique keys; groups are at most a capacity long."""
    where = placed.select(key, "piece", "sequence_id", "offset")
    found = tokens.join(where, [key, "piece"])
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return found.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.transform("parts", lambda p: F.size(p["ids"])).alias("lengths"))
