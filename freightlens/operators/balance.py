"""Class balancing of training rows: weights, synthetic minority rows, and Tomek cleaning.

All choices are hashes of row ids, so a retried task repeats its rows. Synthetic counts are exact.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from freightlens.functions.ranks import range_buckets, row_ranks, running_totals
from freightlens.functions.scalars import hash01, hash_int
from freightlens.operators.neighbors import KnnPlan, knn_join
from freightlens.session import stage
from freightlens.sources.shipments import ID, TARGET


def class_counts(df: DataFrame, label: str = TARGET) -> tuple[int, int]:
    """(negatives, positives)."""
    row = df.agg(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).first()
    return row[0], row[1]


def scale_pos_weight(df: DataFrame, label: str = TARGET) -> float:
    neg, pos = class_counts(df, label)
    return neg / max(pos, 1)


def with_class_weight(df: DataFrame, label: str = TARGET, name: str = "weight") -> DataFrame:
    """Rows unchanged, plus a weight that makes both classes count equally."""
    return df.withColumn(name, F.when(F.col(label) == 1, F.lit(scale_pos_weight(df, label))).otherwise(F.lit(1.0)))


def _ranked(df: DataFrame, seed: int) -> DataFrame:
    """Add `_rank`: a 0-based shuffle position over all rows, ranked in two levels."""
    rows = df.withColumn("_h", hash_int(1_000_003, F.col(ID), F.lit(seed))).withColumn("_all", F.lit(0))
    return row_ranks(rows, ["_all"], F.expr("_h div 100"), [F.col("_h"), F.col(ID)], "_rank").drop("_h", "_all")


def _interpolate(seeds: DataFrame, pairs: DataFrame, minority: DataFrame, dims: list[str], seed: int, label: str) -> DataFrame:
    """Synthetic rows from (ID, _copies) seeds: seed + u * (neighbour - seed) with one u per row."""
    expanded = seeds.where("_copies > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    picks = pairs.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "donor_id"))).alias("near"))  # k per row
    drawn = (
        expanded.join(picks, F.col(ID) == F.col("query_id"))
        .withColumn("_near", F.get("near", hash_int(F.size("near"), F.col(ID), F.col("_i"), F.lit(seed)).cast("int"))["donor_id"])
        .withColumn("_u", hash01(F.col(ID), F.col("_i"), F.lit(seed + 1)))
        .select(ID, "_i", "_near", "_u")
    )
    a = minority.select(ID, *[F.col(c).cast("double").alias(f"a_{c}") for c in dims])
    b = minority.select(F.col(ID).alias("_near"), *[F.col(c).cast("double").alias(f"b_{c}") for c in dims])
    u = F.col("_u")
    return drawn.join(a, ID).join(b, "_near").select(
        F.concat(F.lit("syn-"), F.col(ID), F.lit("-"), F.col("_i").cast("string")).alias(ID),
        *[(F.col(f"a_{c}") + u * (F.col(f"b_{c}") - F.col(f"a_{c}"))).alias(c) for c in dims],
        F.lit(1).alias(label),
    )


def _append(df: DataFrame, synthetic: DataFrame, dims: list[str], label: str) -> DataFrame:
    real = df.select(ID, *[F.col(c).cast("double").alias(c) for c in dims], label)
    return real.withColumn("is_synthetic", F.lit(False)).unionByName(synthetic.withColumn("is_synthetic", F.lit(True)))


def smote(df: DataFrame, dims: list[str], ratio: float = 0.5, k: int = 5, seed: int = 42, label: str = TARGET,
          plan: KnnPlan = KnnPlan()) -> DataFrame:
    """Original rows plus synthetic positives until positives = floor(ratio * negatives).

    Copies are spread evenly: every positive gets need div n and the first need mod n in shuffle order one more.
    """
    df = stage(df.select(ID, *dims, label), "smote")
    neg, pos = class_counts(df, label)
    need = int(ratio * neg) - pos
    minority = df.where(F.col(label) == 1)
    if need <= 0 or pos < 2:
        return _append(df, minority.select(ID, *[F.col(c).cast("double").alias(c) for c in dims], label).limit(0), dims, label)
    pairs = stage(knn_join(minority, minority, k, dims, ID, ID, exclude_self=True, plan=plan), "pairs")
    seeds = _ranked(minority.select(ID), seed).withColumn(
        "_copies", F.lit(need // pos) + F.when(F.col("_rank") < need % pos, 1).otherwise(0)
    )
    return _append(df, _interpolate(seeds, pairs, minority, dims, seed, label), dims, label)


def adasyn(df: DataFrame, dims: list[str], ratio: float = 0.5, k: int = 5, seed: int = 42, label: str = TARGET,
           plan: KnnPlan = KnnPlan()) -> DataFrame:
    """Synthetic positives in proportion to the share of negatives among each positive's neighbours.

    Without any boundary row the even spread of `smote` is used.
    """
    df = stage(df.select(ID, *dims, label), "adasyn")
    neg, pos = class_counts(df, label)
    need = int(ratio * neg) - pos
    minority = df.where(F.col(label) == 1)
    if need <= 0 or pos < 2:
        return smote(df, dims, ratio, k, seed, label, plan)
    around = knn_join(minority, df.withColumn("_y", F.col(label)), k, dims, ID, ID, carry=["_y"], exclude_self=True, plan=plan)
    # whole numbers of negative neighbours out of k, so that no order of summing changes a copy count
    hardness = stage(around.groupBy("query_id").agg(F.count_if(F.col("_y") == 0).alias("r")), "hardness")
    total = hardness.agg(F.sum("r")).first()[0] or 0
    if total == 0:
        return smote(df, dims, ratio, k, seed, label, plan)
    seeds = hardness.select(F.col("query_id").alias(ID), F.rint(F.col("r") * F.lit(need) / F.lit(total)).cast("int").alias("_copies"))
    pairs = stage(knn_join(minority, minority, k, dims, ID, ID, exclude_self=True, plan=plan), "pairs")
    return _append(df, _interpolate(seeds, pairs, minority, dims, seed, label), dims, label)


def tomek_links(df: DataFrame, dims: list[str], label: str = TARGET, plan: KnnPlan = KnnPlan()) -> DataFrame:
    """(id_0, id_1): rows of opposite class that are each other's nearest neighbour."""
    rows = df.withColumn("_y", F.col(label))
    near = knn_join(df, rows, 1, dims, ID, ID, carry=["_y"], exclude_self=True, plan=plan)
    own = df.select(F.col(ID).alias("query_id"), F.col(label).cast("double").alias("_own"))
    across = stage(near.join(own, "query_id").where("_own <> _y").select("query_id", "donor_id", "_own"), "across")
    back = across.select(F.col("query_id").alias("donor_id"), F.col("donor_id").alias("query_id"))
    mutual = across.where("_own = 0").join(back, ["query_id", "donor_id"])
    return mutual.select(F.col("query_id").alias("id_0"), F.col("donor_id").alias("id_1"))


def smote_tomek(df: DataFrame, dims: list[str], ratio: float = 0.5, k: int = 5, seed: int = 42, label: str = TARGET,
                plan: KnnPlan = KnnPlan()) -> DataFrame:
    """`smote`, then both rows of every Tomek link are removed."""
    grown = stage(smote(df, dims, ratio, k, seed, label, plan), "grown")
    links = tomek_links(grown, dims, label, plan)
    gone = links.select(F.explode(F.array("id_0", "id_1")).alias(ID)).distinct()
    return grown.join(gone, ID, "left_anti")


def resample(df: DataFrame, dims: list[str], strategy: str, ratio: float = 0.5, seed: int = 42, label: str = TARGET) -> DataFrame:
    """Training rows balanced by the named strategy, with a `weight` column for the learner."""
    if strategy == "class_weight":
        return with_class_weight(df, label)
    made = {"smote": smote, "adasyn": adasyn, "smote_tomek": smote_tomek}
    if strategy not in made:
        raise ValueError(f"unknown balancing strategy {strategy!r}")
    return made[strategy](df, dims, ratio, seed=seed, label=label).withColumn("weight", F.lit(1.0))


# Fixed value: the largest sample size with an exact law.
EXACT_KS = 10_000


def ks_exact(d: float | None, n: int, m: int) -> float | None:
    """P(statistic >= d) for two samples of n and m from one continuous law; NULL where an argument is missing.

    A random order of both samples is a lattice path; `hit` is the chance that a path to (i, j) has left the band of gaps
    under d. Steps go along antidiagonals, where only the points inside the band are visited.
    """
    if pd.isna(d) or pd.isna(n) or not n or not m:
        return None
    n, m = int(n), int(m)
    common = math.gcd(n, m)
    up, right = m // common, n // common
    edge = round(d * n * up)  # the gap of (i, j) in units of 1 / lcm(n, m) is |i * up - j * right|
    hit = np.ones(n + 3)      # hit[i + 1] belongs to i
    if edge > 0:
        hit[1] = 0.0
    for s in range(1, n + m + 1):
        low = max(0, s - m, (s * right - edge) // (up + right) + 1)
        high = min(n, s, -((-s * right - edge) // (up + right)) - 1)
        if low > high:
            return 1.0
        i = np.arange(low, high + 1)
        inside = (i * hit[low : high + 1] + (s - i) * hit[low + 1 : high + 2]) / s
        hit[low], hit[high + 2] = 1.0, 1.0
        hit[low + 1 : high + 2] = inside
    return float(hit[n + 1])


def ks_two_sample(df: DataFrame, side: Column, columns: list[str]) -> DataFrame:
    """(column, statistic, p_value, diverges): largest gap between the two empirical distributions per column.

    `side` is true for the first sample. Values are counted first; their running totals are taken
    inside range buckets. The p-value is exact while both samples have at most `EXACT_KS` values, else the asymptotic
    Kolmogorov series.
    """
    long = df.select(side.alias("_side"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns
    ]))).where("value IS NOT NULL AND _side IS NOT NULL")
    hist = long.groupBy("column", "value").agg(F.count_if("_side").alias("a"), F.count_if(~F.col("_side")).alias("b"))
    c = F.col
    totals = running_totals(range_buckets(hist, ["column", "value"]), ["column"], "value", ["a", "b"])
    gap = F.abs(F.try_divide(c("a_before") + c("a"), c("a_total")) - F.try_divide(c("b_before") + c("b"), c("b_total")))
    out = totals.groupBy("column").agg(F.max(gap).alias("statistic"), F.max("a_total").alias("n"), F.max("b_total").alias("m"))
    lam = F.sqrt(c("n").cast("double") * c("m") / (c("n") + c("m"))) * c("statistic")
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
        lambda s, j: s + F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * c("_l") * c("_l")),
    )
    law = F.pandas_udf(lambda d, n, m: pd.Series([ks_exact(*v) for v in zip(d, n, m)], dtype=float), "double")
    small = F.greatest("n", "m") <= EXACT_KS
    exact = law(F.when(small, c("statistic")), F.when(small, c("n")), F.when(small, c("m")))  # one row per column
    p = F.when(small, exact).when(c("_l") < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))
    return out.withColumn("_l", lam).select("column", "statistic", p.alias("p_value")).withColumn("diverges", c("p_value") < 0.05)


def quality_gate(balanced: DataFrame, columns: list[str], label: str = TARGET) -> DataFrame:
    """Distribution check of synthetic against real positives on every column."""
    return ks_two_sample(balanced.where(F.col(label) == 1), F.col("is_synthetic"), columns)
