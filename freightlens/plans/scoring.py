"""The main scoring plan: validated shipments -> filled -> engineered -> probability -> threshold -> tier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from freightlens.operators import decide, impute, linear, thresholds
from freightlens.operators.features import ExcursionScaler, engineer, fit_excursion
from freightlens.session import stage
from freightlens.sources.shipments import shipments

NO_SCALER = ExcursionScaler(0.0, 1.0, 0.0, 1.0)


def staged_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shipment view, evaluated once and written to the shared folder for all that reads it."""
    return stage(shipments(spark, sf_dir), "shipments")


def prepared(spark: SparkSession, sf_dir: str, scaler: bool = False, base: DataFrame | None = None) -> DataFrame:
    """Shipments with missing cells filled by global medians and all features engineered. The line items are read once, or
    not at all if the staged view is given as `base`."""
    base = staged_shipments(spark, sf_dir) if base is None else base
    medians = impute.fit_medians(base, staged=True)
    return engineer(impute.fill_medians(base, medians), fit_excursion(base) if scaler else NO_SCALER)


def scored(spark: SparkSession, sf_dir: str, model: linear.LinearModel = linear.DEMO, base: DataFrame | None = None) -> DataFrame:
    return linear.score(prepared(spark, sf_dir, base=base), model)


def tiered(scores: DataFrame, cost: thresholds.CostMatrix = thresholds.CostMatrix()) -> tuple[DataFrame, float]:
    """Scores with the tier implied by the cost-optimal threshold, and that threshold."""
    theta = thresholds.optimize(scores, "asymmetric_cost", cost)
    return scores.withColumn("risk_tier", decide.risk_tier("p", theta)), theta


def intervention_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which shipments need attention: id, probability, threshold and tier."""
    rows, theta = tiered(scored(spark, sf_dir))
    return rows.select("shipment_id", "p", F.lit(theta).alias("theta"), "risk_tier")
