"""Stratified folds and splits that do not depend on row position or partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from freightlens.functions.ranks import row_ranks
from freightlens.functions.scalars import hash_int
from freightlens.sources.shipments import ID, TARGET

MODULUS = 1_000_003
BUCKET_WIDTH = 100  # order values per bucket, 10,001 buckets per class


def numeric_order(key: str = ID, seed: int = 7919) -> Column:
    """A shuffle order for numeric ids: multiplication modulo a prime."""
    return (F.col(key).cast("bigint") * seed) % MODULUS


def hashed_order(key: str = ID, seed: int = 42) -> Column:
    """A shuffle order for any id."""
    return hash_int(MODULUS, F.col(key), F.lit(seed))


def stratified_folds(df: DataFrame, k: int = 5, order: Column | None = None, label: str = TARGET, key: str = ID,
                     name: str = "fold") -> DataFrame:
    """Deal the rows of each class, in shuffled order, over k folds; class shares differ by at most one row.

    The order is ranked in two levels, so a class of any size is spread over thousands of tasks.
    """
    rows = df.withColumn("_order", numeric_order(key) if order is None else order)
    ranked = row_ranks(rows, [label], F.expr(f"_order div {BUCKET_WIDTH}"), [F.col("_order"), F.col(key)], "_rank")
    return ranked.withColumn(name, (F.col("_rank") % k).cast("int")).drop("_order", "_rank")


def tune_eval(df: DataFrame, order: Column | None = None, label: str = TARGET, key: str = ID) -> DataFrame:
    """Stratified halves named `tune` and `eval`."""
    halves = stratified_folds(df, 2, numeric_order(key, 104_729) if order is None else order, label, key, "_half")
    return halves.withColumn("part", F.when(F.col("_half") == 0, "tune").otherwise("eval")).drop("_half")
