"""Content fingerprints and hash-chained audit records."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from freightlens.session import stage
from freightlens.sources.shipments import ID

GENESIS = "0" * 64


def row_digest(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive digest of values and column names: all 256 bits of the row digests, added up in eight parts."""
    columns = sorted(df.columns)
    rows = df.select(row_digest(columns).alias("d"))
    parts = [F.coalesce(F.sum(F.conv(F.substring("d", 1 + 8 * k, 8), 16, 10).cast("bigint").cast("decimal(38,0)")), F.lit(0)).cast("string") for k in range(8)]
    return rows.agg(F.count("*").alias("n_rows"), F.concat_ws("|", *parts).alias("content")).select(
        "n_rows", F.sha2(F.concat_ws("|", F.col("content"), F.lit(",".join(columns))), 256).alias("fingerprint")
    )


def decision_chain(df: DataFrame, records: list[Column], name: str = "chain") -> DataFrame:
    """Hash chain over the ordered audit records of one shipment.

    Each shipment has its own short chain, so chains are built independently on every executor;
    `chain_head` covers the whole history of the shipment.
    """
    seed = F.array(F.struct(F.lit("").alias("record"), F.lit(GENESIS).alias("digest")))

    def link(chain: Column, record: Column) -> Column:
        last = F.element_at(chain, -1)["digest"]
        return F.concat(chain, F.array(F.struct(record.alias("record"), F.sha2(F.concat(last, record), 256).alias("digest"))))

    chain = F.slice(F.aggregate(F.array(*records), seed, link), 2, len(records))
    return df.withColumn(name, chain).withColumn("chain_head", F.element_at(name, -1)["digest"])


def verify_chain(df: DataFrame, name: str = "chain") -> DataFrame:
    """Recompute every chain from its records; `intact` is false when any record or digest was changed."""
    again = F.aggregate(F.col(name), F.lit(GENESIS), lambda acc, link: F.sha2(F.concat(acc, link["record"]), 256))
    pairs = F.transform(F.sequence(F.lit(1), F.size(name)), lambda i: F.get(name, i - 1)["digest"] == F.sha2(
        F.concat(F.when(i == 1, F.lit(GENESIS)).otherwise(F.get(name, F.greatest(i - 2, F.lit(0)))["digest"]), F.get(name, i - 1)["record"]), 256))
    intact = (again == F.col("chain_head")) & F.forall(pairs, lambda ok: ok)
    return df.select(ID, intact.alias("intact"))


LEAF_HEADS = 1_000


def batch_digest(df: DataFrame, head: str = "chain_head", previous: str = GENESIS) -> DataFrame:
    """(n_chains, digest): a Merkle tree over the sorted chain heads of a batch, its root chained to the digest of the batch before.

    Heads are hashes, so their leading hexadecimal digits deal them evenly; as many digits are used as keep a leaf near
    `LEAF_HEADS` heads, and each level above joins 16 children. Equal heads are counted first, so no leaf grows with copies.
    """
    counted = stage(df.groupBy(F.col(head).alias("head")).agg(F.count("*").alias("n")), "heads")
    size = counted.agg(F.count("*").alias("heads"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    digits = max(math.ceil(math.log(max(size["heads"] / LEAF_HEADS, 1), 16)), 1)
    level = counted.select(F.substring("head", 1, digits).alias("at"), F.concat_ws(":", "head", "n").alias("part"))
    while digits >= 0:
        joined = F.sha2(F.array_join(F.sort_array(F.collect_list(F.struct("part"))).part, "|"), 256)
        digits -= 1
        level = level.groupBy("at").agg(joined.alias("digest")).select(
            F.substring("at", 1, max(digits, 0)).alias("at"), F.concat_ws("=", "at", "digest").alias("part"))
    root = level.agg(F.coalesce(F.max("part"), F.lit("")).alias("root"))
    return root.select(F.lit(size["n"]).cast("bigint").alias("n_chains"), F.sha2(F.concat(F.lit(previous), F.col("root")), 256).alias("digest"))
