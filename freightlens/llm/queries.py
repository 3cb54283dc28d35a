"""Registered queries of this folder: the operators over their whole tables, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from freightlens.llm import chat, decontaminate, exact, fim, fingerprints, langid, licenses, negatives, packing, secrets, simhash, urls, warc
from freightlens.llm.tables import read
from freightlens.session import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: A setting like any other: where the tokenizer file is on every machine.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: A conversation whose texts look like the template, with the number that no other has.
TRICKY = (-7, "\\### Assistant: </turn> ok")
RULES = [
    urls.Rule("allow", "com", "/"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"), urls.Rule("block", "net", "/fr/"),
]


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


@query("op1_decontamination")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    return decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS lines,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS trained,
         CAST(sum(14 + length(role) + length(replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## '))) AS BIGINT) AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, CAST(length(trained) AS BIGINT) AS loss_chars, sha256(trained) AS loss_sha256, formatted_chars
FROM g
"""


@query("op2_chat_formatting", CHAT_SQL)
def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations through an event log, folded, rendered and read back."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(TRICKY[0], 0, "user", TRICKY[1]), (TRICKY[0], 1, "assistant", TRICKY[1])], turns.schema)
    log = chat.log_of(turns.unionByName(extra))
    out = chat.format_log(log, "conversation", ["turn", "copy"])
    back = out.select("conversation", "formatted", "loss_mask", chat.read_turns(F.col("formatted")).alias("turns"),
                      chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("trained"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("conversation").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


@query("op3_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    found = secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    of_kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id", *[F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k, *_ in secrets.BASE],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != secrets.ENTROPY)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes,
       rtrim(b32.digest) AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (html), LATERAL (
  SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((v // (32 ** (7 - k))::BIGINT) % 32 AS INT), 1), '' ORDER BY g, k) AS digest
  FROM (SELECT g, CAST('0x' || substr(sha1(p.html), 1 + 10 * g, 10) AS BIGINT) AS v FROM range(4) t(g)) d, range(8) u(k)) b32
"""


@query("op4_warc_roundtrip", WARC_SQL)
def warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    return warc.archived(read(spark, sf_dir, "pages"))


@query("op5_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = read(spark, sf_dir, "documents")
    model = langid.learn(spark, docs)
    rows = docs.select("doc_id", F.coalesce(langid.held_out(), F.lit(True)).alias("held_out"), "text")
    return langid.predict(rows, model)


@query("op6_simhash_near_duplicates")
def simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query("op7_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in documents."""
    return licenses.find_licenses(read(spark, sf_dir, "documents"))


@query("op8_url_filter")
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return urls.filtered(read(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict", "score")


@query("op9_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the packed sequences."""
    return packed(read(spark, sf_dir, "documents"))


def packed(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    cut = stage(packing.pieces(docs, tokenizer, with_ids=False), "pieces")
    return packing.place(cut, ["doc_id", "piece", "ids_crc32"])


@query("op10_document_fingerprints")
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of documents and of their edited texts, and how alike they are."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chained = fingerprints.with_next(fingerprints.fingerprinted(docs), "doc_id", ["text", "fingerprint"], "text")
    edited = chained.select("doc_id", "text", "fingerprint", "next_fingerprint", fingerprints.half_edited(F.col("text"), F.col("next_text")).alias("edited"))
    both = edited.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
                         "next_fingerprint", fingerprints.fingerprint(F.col("edited")).alias("edited_fingerprint"))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", fingerprints.digits(F.col("fingerprint")).alias("fingerprint"),
        fingerprints.digits(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        fingerprints.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


FIM_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS drawn FROM documents),
h AS (
  SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n, CAST('0x' || substr(drawn, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(drawn, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(drawn, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(drawn, 25, 8) AS BIGINT) AS h4 FROM d),
f AS (
  SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form = 'plain' THEN NULL ELSE a END AS prefix_chars, CASE WHEN form = 'plain' THEN NULL ELSE b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""


@query("op11_fill_in_middle", FIM_SQL)
def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents rearranged, and restored from what was written."""
    written = fim.transformed(read(spark, sf_dir, "documents").select("doc_id", "text"))
    named = written.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", "fim.output", "fim.output_sha256")
    back = fim.restored(named, "output", "form")
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.col("restored.sha256").alias("restored_sha256"))


NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id, CAST(row_number() OVER w AS INT) AS rank, n.other_id AS negative_id,
       p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id)
QUALIFY row_number() OVER w <= 3
"""


@query("op12_hard_negatives", NEGATIVES_SQL)
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of every anchor's nearest positives, over all embeddings."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return negatives.mine(vectors, F.col("vec_id") % 50 == 0)


EXACT_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256 FROM d JOIN g USING (text)
"""


@query("op13_exact_dedup", EXACT_SQL)
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of every document."""
    found = exact.groups(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"),
                        F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.col("digest").alias("text_sha256"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline, all stages."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
