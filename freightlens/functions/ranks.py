"""Global ranks and running totals in two levels: no window ever spans the whole table.

Level one orders a small table with one row per bucket; level two orders rows inside a bucket.
Buckets follow the order of the key, so position = rows in earlier buckets + position in bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from freightlens.session import stage


def range_buckets(df: DataFrame, keys: list[str]) -> DataFrame:
    """Add `_bucket`, increasing with `keys`, from Spark's own range partitioning.

    The boundaries come from a sample, so the result is staged: later readers must all see the
    same assignment.
    """
    return stage(df.repartitionByRange(*keys).withColumn("_bucket", F.spark_partition_id()), "ranges")


def _bucket_offsets(df: DataFrame, group: list[str], sums: dict[str, Column], descending: bool) -> DataFrame:
    order = F.col("_bucket").desc() if descending else F.col("_bucket")
    before = Window.partitionBy("_group", *group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, "_bucket").agg(*[c.alias(n) for n, c in sums.items()])
    every = Window.partitionBy("_group", *group)
    return totals.withColumn("_group", F.lit(0)).select(
        *group, "_bucket",
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_off_{n}") for n in sums],
        *[F.sum(n).over(every).alias(f"{n}_total") for n in sums],
    )


def row_ranks(df: DataFrame, group: list[str], bucket: Column, order: list[Column], name: str = "rank") -> DataFrame:
    """0-based position of each row within its group; `bucket` must be monotone in the leading order key
    and take a bounded number of values."""
    rows = df.withColumn("_bucket", bucket)
    offsets = _bucket_offsets(rows, group, {"n": F.count("*")}, False)
    within = Window.partitionBy(*group, "_bucket").orderBy(*order)
    return (
        rows.withColumn("_pos", F.row_number().over(within))
        .join(F.broadcast(offsets), [*group, "_bucket"])
        .withColumn(name, F.col("_off_n") + F.col("_pos") - 1)
        .drop("_bucket", "_pos", "_off_n", "n_total")
    )


def running_totals(hist: DataFrame, group: list[str], key: str, sums: list[str], descending: bool = False) -> DataFrame:
    """Add `<name>_before`, the total of `name` over keys strictly before this one, and `<name>_total`.

    `hist` has one row per (group, key) and a `_bucket` column monotone in `key`. The bucket
    table has one row per bucket, a number fixed by the bucketing rule and not by the data.
    """
    offsets = _bucket_offsets(hist, group, {s: F.sum(s) for s in sums}, descending)
    order = F.col(key).desc() if descending else F.col(key)
    before = Window.partitionBy(*group, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = hist.select("*", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_loc_{s}") for s in sums])
    joined = local.join(F.broadcast(offsets), [*group, "_bucket"])
    return joined.withColumns({f"{s}_before": F.col(f"_off_{s}") + F.col(f"_loc_{s}") for s in sums}).drop(
        "_bucket", *[f"_off_{s}" for s in sums], *[f"_loc_{s}" for s in sums]
    )
