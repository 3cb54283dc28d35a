"""Classification metrics from aggregates over (label, score)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from freightlens.functions.scalars import MICRO, micros, ratio, ratio_or_zero, snap, unpivot_structs
from freightlens.functions.ranks import range_buckets, running_totals
from freightlens.operators.thresholds import cumulative, exact_histogram
from freightlens.sources.shipments import TARGET

EPS = float(np.finfo(np.float64).eps)
POINT_METRICS = ["f1", "recall", "precision", "specificity", "mcc"]
# The quality each metric must reach.
TARGETS = [("f1", 0.90), ("roc_auc", 0.92), ("recall", 0.95), ("precision", 0.55)]


def confusion_aggregates(score: str, label: str, threshold: float | Column) -> list[Column]:
    theta = threshold if isinstance(threshold, Column) else F.lit(int(threshold * MICRO + 0.5))
    hit, y = micros(score) >= theta, F.col(label)
    return [
        F.count_if((y == 0) & ~hit).alias("tn"), F.count_if((y == 0) & hit).alias("fp"),
        F.count_if((y == 1) & ~hit).alias("fn"), F.count_if((y == 1) & hit).alias("tp"),
    ]


def point_metrics(prefix: str = "") -> dict[str, Column]:
    """Metrics as algebra over columns tn, fp, fn, tp; zero denominators give 0."""
    tn, fp, fn, tp = [F.col(prefix + k).cast("double") for k in ("tn", "fp", "fn", "tp")]
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return {
        "f1": ratio_or_zero(2 * tp, 2 * tp + fp + fn),
        "recall": ratio_or_zero(tp, tp + fn),
        "precision": ratio_or_zero(tp, tp + fp),
        "specificity": ratio_or_zero(tn, tn + fp),
        "mcc": ratio_or_zero(tp * tn - fp * fn, root),
    }


def confusion(scored: DataFrame, threshold: float, score: str = "p", label: str = TARGET, by: list[str] = ()) -> DataFrame:
    return scored.where(F.col(score).isNotNull()).groupBy(*by).agg(*confusion_aggregates(score, label, threshold))


def classification_metrics(scored: DataFrame, threshold: float, score: str = "p", label: str = TARGET, by: list[str] = ()) -> DataFrame:
    counts = confusion(scored, threshold, score, label, by)
    return counts.select(*by, "tn", "fp", "fn", "tp", *[snap(c).alias(n) for n, c in point_metrics().items()])


def roc_auc_column() -> Column:
    """Rank statistic over the cumulative curve; tied scores count one half; NULL for a single class."""
    d = lambda n: F.col(n).cast("double")
    area = F.sum(d("neg") * (d("tp") - d("pos") / 2.0))
    return ratio(area, F.max(d("P")) * F.max(d("N")))


def average_precision_column() -> Column:
    """Step-wise sum of precision over recall increments, not the trapezoid."""
    d = lambda n: F.col(n).cast("double")
    return ratio(F.sum(d("pos") * ratio(F.col("tp"), F.col("tp") + F.col("fp"))), F.max(d("P")))


def rank_metrics(hist: DataFrame) -> DataFrame:
    """roc_auc and pr_auc of one score histogram."""
    return cumulative(hist).agg(roc_auc_column().alias("roc_auc"), average_precision_column().alias("pr_auc"))


def roc_auc(scored: DataFrame, score: str = "p", label: str = TARGET) -> DataFrame:
    return cumulative(exact_histogram(scored, score, label)).agg(snap(roc_auc_column()).alias("roc_auc"))


def average_precision(scored: DataFrame, score: str = "p", label: str = TARGET) -> DataFrame:
    return cumulative(exact_histogram(scored, score, label)).agg(snap(average_precision_column()).alias("pr_auc"))


def loss_aggregates(score: str = "p", label: str = TARGET) -> list[Column]:
    p, y = F.col(score), F.col(label)
    safe = F.least(F.greatest(p, F.lit(EPS)), F.lit(1.0 - EPS))
    return [
        F.avg(-F.when(y == 1, F.ln(safe)).otherwise(F.ln(1.0 - safe))).alias("log_loss"),
        F.avg((p - y) * (p - y)).alias("brier"),
    ]


def log_loss_brier(scored: DataFrame, score: str = "p", label: str = TARGET) -> DataFrame:
    return scored.where(F.col(score).isNotNull()).agg(*loss_aggregates(score, label)).select(
        snap("log_loss").alias("log_loss"), snap("brier").alias("brier")
    )


def all_metrics(scored: DataFrame, threshold: float, score: str = "p", label: str = TARGET) -> DataFrame:
    """All nine metrics and the confusion counts from one pass.

    The pass keeps one row per distinct score, unrounded, with its losses summed, so losses,
    confusion counts and the two ranking areas all come from the same histogram.
    """
    p, y = F.col(score), F.col(label)
    safe = F.least(F.greatest(p, F.lit(EPS)), F.lit(1.0 - EPS))
    loss = -F.when(y == 1, F.ln(safe)).otherwise(F.ln(1.0 - safe))
    hist = (
        scored.where(p.isNotNull() & y.isNotNull()).groupBy(p.cast("double").alias("m"))
        .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"), F.sum(loss).alias("loss"),
             F.sum((p - y) * (p - y)).alias("square"))
    )
    hist = range_buckets(hist, ["m"])
    c = F.col
    curve = running_totals(hist, [], "m", ["pos", "neg"], descending=True).withColumns({
        "tp": c("pos_before") + c("pos"), "fp": c("neg_before") + c("neg"), "P": c("pos_total"), "N": c("neg_total"),
    })
    hit = micros("m") >= F.lit(int(threshold * MICRO + 0.5))
    wide = curve.agg(
        F.sum(F.when(hit, 0).otherwise(c("neg"))).alias("tn"), F.sum(F.when(hit, c("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(c("pos"))).alias("fn"), F.sum(F.when(hit, c("pos")).otherwise(0)).alias("tp"),
        roc_auc_column().alias("roc_auc"), average_precision_column().alias("pr_auc"),
        F.sum("loss").alias("loss"), F.sum("square").alias("square"), F.sum(c("pos") + c("neg")).alias("n"),
    )
    return wide.select(
        *[snap(v).alias(n) for n, v in point_metrics().items()],
        snap("roc_auc").alias("roc_auc"), snap("pr_auc").alias("pr_auc"),
        snap(ratio(c("loss"), c("n"))).alias("log_loss"), snap(ratio(c("square"), c("n"))).alias("brier"),
        F.lit(float(threshold)).alias("threshold"), "tn", "fp", "fn", "tp",
    )


# The metrics of an experiment.
METRIC_NAMES = ["f1", "roc_auc", "recall", "precision", "specificity", "mcc", "pr_auc", "log_loss", "brier"]


def aggregate_folds(per_fold: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Mean and sample deviation of each metric over folds."""
    return per_fold.groupBy(*by).agg(
        *[snap(F.avg(n)).alias(f"{n}_mean") for n in names], *[snap(F.stddev_samp(n)).alias(f"{n}_std") for n in names]
    )


def confusion_table(counts: DataFrame, by: list[str]) -> DataFrame:
    """Counts tn, fp, fn, tp summed over folds, and each as a share of its true class; an absent class gives NULL shares."""
    total = counts.groupBy(*by).agg(*[F.sum(k).alias(k) for k in ("tn", "fp", "fn", "tp")])
    share = lambda a, b: snap(ratio(F.col(a).cast("double"), F.col(a) + F.col(b)))
    return total.select(*by, "tn", "fp", "fn", "tp", share("tn", "fp").alias("tn_share"), share("fp", "tn").alias("fp_share"),
                        share("fn", "tp").alias("fn_share"), share("tp", "fn").alias("tp_share"))


def comparison_table(counts: DataFrame, by: list[str], model: str = "model") -> DataFrame:
    """The table behind a model-comparison chart: one row per (by, metric) with the value of all folds' counts together, and
    whether no other model is better under the rest of `by`; ties share the first place. One row per model is ranked."""
    points = confusion_table(counts, by).withColumns({n: snap(c) for n, c in point_metrics().items()})
    rows = points.select(*by, unpivot_structs([F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in POINT_METRICS]))
    rest = Window.partitionBy("metric", *[c for c in by if c != model])
    return rows.withColumn("is_best", F.col("value") == F.max("value").over(rest))


def bootstrap_ci(scored: DataFrame, threshold: float, metric: str = "f1", replicates: int = 1000, alpha: float = 0.05,
                 seed: int = 42, score: str = "p", label: str = TARGET) -> DataFrame:
    """Percentile interval of a thresholded metric.

    Resampling n rows with replacement and counting outcomes is exactly one multinomial draw over
    the four confusion shares, so each replicate costs four numbers whatever n is. Replicates
    with a single true class are skipped.
    """
    row = confusion(scored, threshold, score, label).first()
    counts = np.array([row["tn"], row["fp"], row["fn"], row["tp"]], dtype=float)
    total = int(counts.sum())

    def draw(batches):
        for ids in batches:
            drawn = [np.random.default_rng([seed, int(i)]).multinomial(total, counts / max(total, 1)) for i in ids["id"]]
            yield pd.DataFrame(np.array(drawn).reshape(-1, 4), columns=["tn", "fp", "fn", "tp"]).astype("int64")

    reps = scored.sparkSession.range(replicates).mapInPandas(draw, "tn bigint, fp bigint, fn bigint, tp bigint")
    valid = reps.where((F.col("fn") + F.col("tp") > 0) & (F.col("tn") + F.col("fp") > 0))
    observed = {k: F.lit(float(v)) for k, v in zip(("tn", "fp", "fn", "tp"), counts)}
    valid = valid.withColumn("value", point_metrics()[metric])
    tp, fp, fn, tn = observed["tp"], observed["fp"], observed["fn"], observed["tn"]
    points = {
        "f1": ratio_or_zero(2 * tp, 2 * tp + fp + fn), "recall": ratio_or_zero(tp, tp + fn),
        "precision": ratio_or_zero(tp, tp + fp), "specificity": ratio_or_zero(tn, tn + fp),
        "mcc": ratio_or_zero(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
    }
    return valid.agg(
        F.lit(metric).alias("metric"), F.first(snap(points[metric])).alias("value"), snap(F.avg("value")).alias("mean"),
        snap(F.percentile("value", F.lit(alpha / 2))).alias("ci_lower"),
        snap(F.percentile("value", F.lit(1 - alpha / 2))).alias("ci_upper"), F.count("*").alias("n_replicates"),
    )


def target_gate(metrics: DataFrame, targets: list[tuple[str, float]] = TARGETS) -> DataFrame:
    """One row per target: value, target and whether it is reached."""
    return metrics.select(unpivot_structs([
        F.struct(F.lit(n).alias("metric"), F.col(n).alias("value"), F.lit(t).alias("target"), (F.col(n) >= t).alias("passed"))
        for n, t in targets
    ]))


def roc_points(scored: DataFrame, score: str = "p", label: str = TARGET) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score."""
    c = F.col
    return cumulative(exact_histogram(scored, score, label)).select(
        c("m").alias("threshold"),
        snap(ratio(c("fp"), c("N"))).alias("fpr"), snap(ratio(c("tp"), c("P"))).alias("tpr"),
    )


def pr_points(scored: DataFrame, score: str = "p", label: str = TARGET) -> DataFrame:
    """(threshold, precision, recall) at every distinct score."""
    c = F.col
    return cumulative(exact_histogram(scored, score, label)).select(
        c("m").alias("threshold"),
        snap(ratio_or_zero(c("tp"), c("tp") + c("fp"))).alias("precision"),
        snap(ratio_or_zero(c("tp"), c("P"))).alias("recall"),
    )
