"""Decision thresholds from one score histogram.

The sweep compares scores in whole millionths and thresholds in whole hundredths, so `p >= theta` has
one meaning everywhere (0.29 belongs to theta 0.29). What ranks scores uses them unrounded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from freightlens.functions.ranks import range_buckets, running_totals
from freightlens.functions.scalars import MICRO, micros, ratio_or_zero, snap
from freightlens.sources.shipments import TARGET



@dataclass(frozen=True)
class CostMatrix:
    """Relative cost of each outcome and the recall that must be reached."""

    tn: float = 0.0
    fp: float = 1.0
    fn: float = 20.0
    tp: float = 2.0
    recall_floor: float = 0.95


COST_GRID = (5, 50)   # hundredths: 0.05 .. 0.50
F1_GRID = (5, 94)     # hundredths: 0.05 .. 0.94


def exact_histogram(scored: DataFrame, score: str, label: str = TARGET) -> DataFrame:
    """(m, pos, neg, _bucket): rows per distinct unrounded score; what ranks scores reads this."""
    hist = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("m")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    return range_buckets(hist, ["m"])


def cumulative(hist: DataFrame) -> DataFrame:
    """Per distinct score: its own pos and neg, tp and fp (rows at or above it), and the class sizes P and N."""
    c = F.col
    return running_totals(hist, [], "m", ["pos", "neg"], descending=True).select(
        "m", "pos", "neg", (c("pos_before") + c("pos")).alias("tp"), (c("neg_before") + c("neg")).alias("fp"),
        c("pos_total").alias("P"), c("neg_total").alias("N"),
    )


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio_or_zero(2 * tp, 2 * tp + fp + fn)


def sweep(scored: DataFrame, grid: tuple[int, int] = COST_GRID, cost: CostMatrix = CostMatrix(),
          score: str = "p", label: str = TARGET) -> DataFrame:
    """One row per threshold: confusion counts, recall, precision, f1 and cost.

    The rows are read once into at most 101 hundredth-wide bins; each threshold then sums the
    bins at or above it.
    """
    bins = (
        scored.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.floor(micros(score) / 10_000).alias("bin"))
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
        .agg(F.collect_list(F.struct("bin", "pos", "neg")).alias("bins"))  # one struct per bin, 101 at most
    )

    def total(field: str, keep) -> Column:
        return F.aggregate(
            F.filter("bins", keep), F.lit(0).cast("bigint"), lambda a, b: a + b[field]
        )

    theta = F.col("theta_pct")
    rows = bins.withColumn("theta_pct", F.explode(F.sequence(F.lit(grid[0]), F.lit(grid[1])))).select(
        "theta_pct",
        total("neg", lambda b: b["bin"] < theta).alias("tn"), total("neg", lambda b: b["bin"] >= theta).alias("fp"),
        total("pos", lambda b: b["bin"] < theta).alias("fn"), total("pos", lambda b: b["bin"] >= theta).alias("tp"),
    )
    c = F.col
    return rows.select(
        (c("theta_pct") / F.lit(100.0)).alias("theta"),
        "tn", "fp", "fn", "tp",
        snap(ratio_or_zero(c("tp"), c("tp") + c("fn"))).alias("recall"),
        snap(ratio_or_zero(c("tp"), c("tp") + c("fp"))).alias("precision"),
        snap(_f1(c("tp"), c("fp"), c("fn"))).alias("f1"),
        (cost.tn * c("tn") + cost.fp * c("fp") + cost.fn * c("fn") + cost.tp * c("tp")).alias("cost"),
    )


def _four_digits(value: Column) -> Column:
    """Four decimals, the precision at which floors and ties are judged."""
    return F.floor(value * 10_000.0 + 0.5)


def pick_cost(swept: DataFrame, cost: CostMatrix = CostMatrix()) -> DataFrame:
    """Cheapest threshold whose recall reaches the floor (lowest on ties); if none does, the one with most recall."""
    good = _four_digits(F.col("recall")) >= F.lit(int(cost.recall_floor * 10_000 + 0.5))
    fields = F.struct("theta", "recall", "precision", "f1", "cost")
    picked = swept.agg(
        F.min_by(fields, F.when(good, F.struct("cost", "theta"))).alias("ok"),
        F.max_by(fields, F.struct(_four_digits(F.col("recall")).alias("r"), (-F.col("theta")).alias("t"))).alias("fallback"),
    )
    return picked.select(F.coalesce("ok", "fallback").alias("w"), F.col("ok").isNotNull().alias("floor_reached")).select(
        "w.*", "floor_reached"
    )


def pick_f1(swept: DataFrame) -> DataFrame:
    """Threshold with the best f1 at four decimals, lowest on ties."""
    rank = F.struct(_four_digits(F.col("f1")).alias("f"), (-F.col("theta")).alias("t"))
    return swept.agg(F.max_by(F.struct("theta", "recall", "precision", "f1"), rank).alias("w")).select("w.*")


def pick_youden(scored: DataFrame, score: str = "p", label: str = TARGET) -> DataFrame:
    """Score that maximises tpr - fpr (highest score on ties); infinity when nothing beats zero."""
    curve = cumulative(exact_histogram(scored, score, label))
    # tpr - fpr = (tp*N - fp*P) / (P*N): the numerator ranks the scores without rounding
    gain = F.col("tp").cast("double") * F.col("N") - F.col("fp").cast("double") * F.col("P")
    top = curve.agg(
        F.max_by(F.struct("m", "tp", "fp", "P", "N"), F.struct(gain.alias("g"), "m")).alias("w"), F.max(gain).alias("g")
    )
    beats = F.col("g") > 0
    return top.select(
        F.when(beats, F.col("w.m")).otherwise(F.lit(float("inf"))).alias("theta"),
        snap(F.when(beats, ratio_or_zero(F.col("w.tp"), F.col("w.P"))).otherwise(0.0)).alias("tpr"),
        snap(F.when(beats, ratio_or_zero(F.col("w.fp"), F.col("w.N"))).otherwise(0.0)).alias("fpr"),
    )


def optimize(scored: DataFrame, strategy: str, cost: CostMatrix = CostMatrix(), score: str = "p", label: str = TARGET) -> float:
    """The threshold chosen by the named strategy."""
    if strategy == "asymmetric_cost":
        row = pick_cost(sweep(scored, COST_GRID, cost, score, label), cost).first()
    elif strategy == "f1_max":
        row = pick_f1(sweep(scored, F1_GRID, cost, score, label)).first()
    elif strategy == "youden_j":
        row = pick_youden(scored, score, label).first()
    else:
        raise ValueError(f"unknown threshold strategy {strategy!r}")
    return row["theta"]
