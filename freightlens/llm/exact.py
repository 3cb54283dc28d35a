"""Exact de-duplication by skew-safe combining, with DataFrame functions only.

Texts are equal when identical after lower-casing A-Z. Equal texts are combined in three stages, and the text itself is a
key in each, so equality is always decided on full content: within a task (map-side aggregation), among tasks that share a
salt (exchange by digest, salt and text), and among the salts of a digest (exchange by digest). Only digests that hold a
share of all rows are salted; by arithmetic there are at most `HOT_PARTS` of them, so they may be broadcast. What a hot
group sends is one row per task, whatever its size.

Texts move only where they can have an equal: digests seen twice set a bit in a filter of fixed size, and rows that miss it
are groups of one. Rows find their group by digest, which is narrow; where one digest stands for several texts, by text.
"""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, functions as F

from freightlens.session import stage

#: A digest is hot when it has one row in this many, or more.
HOT_PARTS = 4096
#: Salts of a hot digest.
SALTS = 64
#: Bits of the filter of repeated digests: 16 MB, in rows of 32,768 bits.
FILTER_BITS = 1 << 27


def normalised(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; NULL is empty. `lower` does it where every character is one byte."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _bit(digest: Column) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(FILTER_BITS)) + 1  # buckets of the bitmap functions start at 1


def filter_of(repeated: DataFrame) -> DataFrame:
    """(bucket, bits): a bit for each digest of `repeated`; FILTER_BITS / 32,768 rows at most."""
    bit = _bit(F.col("digest"))
    return repeated.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))


def marked(rows: DataFrame, bitmap: DataFrame) -> DataFrame:
    """`rows` and `may_repeat`: true for all repeated digests, and for few others."""
    bit = _bit(F.col("digest"))
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    joined = rows.join(F.broadcast(bitmap), F.bitmap_bucket_number(bit) == F.col("bucket"), "left")
    return joined.select(*rows.columns, is_set.alias("may_repeat"))


def _combined(rows: DataFrame, hot: DataFrame, salts: int) -> DataFrame:
    """(digest, text, keep, size) for each different text of `rows` (id, digest, text)."""
    hinted = rows.join(F.broadcast(hot.select("digest", F.lit(True).alias("is_hot"))), "digest", "left")
    salt = F.when(F.col("is_hot"), F.pmod(F.spark_partition_id(), F.lit(salts))).otherwise(0)
    salted = hinted.select("id", "digest", "text", salt.alias("salt"))
    merged = salted.groupBy("digest", "salt", "text").agg(F.max("id").alias("keep"), F.count("*").alias("size"))
    return merged.repartition("digest").groupBy("digest", "text").agg(F.max("keep").alias("keep"), F.sum("size").alias("size"))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """(id, digest, keep, size) for every row of `docs`: the largest key of its group of equal texts, and the group's rows.

    NULL texts are empty texts. NULL keys lose to any other; a group of NULL keys alone has a NULL keep. Rows that repeat a
    key and a text each get a row and are counted. Empty and very long texts are texts like others; an empty table gives no
    rows. `digest` only routes rows: with a weak one the result is the same, and more texts move.
    """
    rows = docs.select(F.col(key).alias("id"), normalised(F.col(text)).alias("text")).withColumn("digest", digest(F.col("text")))
    members = stage(rows.select("id", "digest"), "members")
    counted = stage(members.groupBy("digest").agg(F.count("*").alias("rows")).where("rows > 1"), "repeated")
    hot = counted.where(F.col("rows") * HOT_PARTS >= members.count())
    texts = _combined(marked(rows, filter_of(counted)).where("may_repeat"), hot, salts)
    found = texts.groupBy("digest").agg(F.count("*").alias("texts"), F.max("keep").alias("keep"), F.sum("size").alias("size"))
    found = stage(found.where("size > 1"), "groups")

    single = found.where("texts = 1").select("digest", "keep", "size")
    told = lambda rows, to: rows.join(to.withColumn("is_told", F.lit(True)), "digest", "left")
    in_hot = told(members, F.broadcast(single.join(F.broadcast(hot), "digest", "left_semi")))
    rest = in_hot.where("is_told IS NULL").select("id", "digest")
    shared = found.where("texts > 1").select("digest")
    clash = bool(shared.take(1))
    if clash:
        rest = rest.join(shared, "digest", "left_anti")
    rest = told(rest, single).select("id", "digest", F.when(F.col("is_told"), F.col("keep")).otherwise(F.col("id")).alias("keep"), F.coalesce("size", F.lit(1)).alias("size"))
    out = in_hot.where("is_told").select("id", "digest", "keep", "size").unionByName(rest)
    if clash:
        among = rows.join(shared, "digest", "left_semi")
        by_text = _combined(among, hot, salts)
        out = out.unionByName(among.join(by_text, ["digest", "text"]).select("id", "digest", "keep", "size"))
    return out


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row of each group of equal texts: that with the largest key. All columns stay as they are, whatever
    their names. Of rows that repeat key and text, one stays (any). Texts without an equal are not moved."""
    told = stage(groups(docs, key, text), "groups")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("id"), sha256(normalised(F.col(text))).alias("digest"))
    flagged = marked(rows, filter_of(told.where("size > 1").select("digest").distinct()))
    stays = told.where("id <=> keep").select(F.col("id").alias("its_id"), F.col("digest").alias("its_digest"))
    among = flagged.where("may_repeat").join(stays, F.col("id").eqNullSafe(F.col("its_id")) & (F.col("digest") == F.col("its_digest")), "left_semi")
    return flagged.where("NOT may_repeat").select("row.*").unionByName(among.dropDuplicates(["digest", "id"]).select("row.*"))
