"""Explanation records: agreement of two rankings, attribution payloads, drift of importance."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from freightlens.functions.scalars import snap
from freightlens.sources.shipments import ID


def agreement(a: DataFrame, b: DataFrame, k: int = 3, left: str = "contributions", right: str = "contributions") -> DataFrame:
    """Per shipment: share of the top-k features two explanations have in common (exact names)."""
    first = a.select(ID, F.transform(F.slice(left, 1, k), lambda c: c["feature"]).alias("_a"))
    second = b.select(ID, F.transform(F.slice(right, 1, k), lambda c: c["feature"]).alias("_b"))
    return first.join(second, ID).select(
        ID, F.concat_ws(",", F.sort_array("_a")).alias("first_top"), F.concat_ws(",", F.sort_array("_b")).alias("second_top"),
        snap(F.size(F.array_intersect("_a", "_b")) / F.lit(float(max(k, 1)))).alias("overlap_ratio"),
    )


def mean_agreement(per_row: DataFrame, target: float = 0.90) -> DataFrame:
    return per_row.agg(F.count("*").alias("n_samples"), snap(F.avg("overlap_ratio")).alias("mean_agreement")).withColumn(
        "reached", F.col("mean_agreement") >= target
    )


def payload(df: DataFrame, theta: float, run_at: str, model_version: str, method: str = "TreeSHAP",
            anomaly: str | None = None, agreed: str | None = None) -> DataFrame:
    """The 11-field attribution record; `run_at` is fixed per run so that reruns write equal records."""
    optional = lambda c: snap(c, 10_000) if c else F.lit(None).cast("double")
    return df.select(
        ID, snap("p", 10_000).alias("failure_probability"), "risk_tier",
        F.slice("contributions", 1, 5).alias("top_contributing_features"),
        optional(anomaly).alias("anomaly_reconstruction_score"), F.lit(model_version).alias("model_version"),
        snap(F.lit(float(theta)), 10_000).alias("threshold_used"), F.lit(method).alias("explanation_method"),
        F.lit("LIME").alias("corroboration_method"), optional(agreed).alias("corroboration_agreement"),
        F.lit(run_at).cast("timestamp").alias("timestamp"),
    )


def save_payloads(payloads: DataFrame, path: str) -> None:
    """JSON lines in one folder per run day."""
    payloads.withColumn("run_date", F.to_date("timestamp")).write.mode("append").partitionBy("run_date").json(path)


def importance_drift(old: DataFrame, new: DataFrame, value: str = "mean_abs_shap") -> DataFrame:
    """Change of importance and of rank per feature between two models; one row per feature on each side."""
    def ranked(df: DataFrame, tag: str) -> DataFrame:
        packed = df.agg(F.sort_array(F.collect_list(F.struct((-F.col(value)).alias("n"), "feature"))).alias("all"))
        return packed.select(F.posexplode("all").alias(f"{tag}_rank", "e")).select(
            F.col("e.feature").alias("feature"), (-F.col("e.n")).alias(f"{tag}_value"), (F.col(f"{tag}_rank") + 1).alias(f"{tag}_rank")
        )

    both = ranked(old, "old").join(ranked(new, "new"), "feature", "full")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select(
        "feature", "old_rank", "new_rank",
        snap(zero(F.col("new_value")) - zero(F.col("old_value"))).alias("change"),
    )


