"""Risk tiers, dominant features and recommended actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from freightlens.functions.scalars import micros, snap

HIGH_OFFSET = 0.35
DOMINANCE = 0.15

# Rules in order of precedence (id, triggering features, lowest tier, action, rationale).
ACTION_RULES = [
    ("thermal_intervention", ["excursion_intensity", "temp_range_c"], "High", "Reroute / Re-cool",
     "Cumulative unmonitored thermal exposure is the primary driver"),
    ("physical_handling", ["vibration_index", "vibration_rate"], "High", "QA Flag — Physical Handling Stress",
     "Route to physical inspection for packaging integrity"),
    ("door_discipline", ["door_opens"], "Medium", "QA Flag — Handling Protocol Review",
     "Flag origin/handling facility for door-discipline audit"),
    ("humidity_exposure", ["rh_max", "rh_range"], "Medium", "QA Flag — Humidity Exposure",
     "Route to potency/stability re-test prior to release"),
    ("sensor_audit", ["sensor_gap_hours"], "Medium", "Sensor / Telemetry Audit",
     "Flag hardware/connectivity fault rather than genuine product failure"),
]
DISCORDANCE = ("ae_discordance", "Escalate for Manual Review", "Discordance between temporal and tabular models")
DIFFUSE = ("diffuse", "Monitor / Log Only", "Probability elevated by combination of weak signals; "
           "insufficient causal concentration to justify intervention")
DEFAULT = ("default", "Monitor / Log Only", "No matching action rule; default to monitoring")
TIER_RANK = {"Low": 0, "Medium": 1, "High": 2}


def risk_tier(p: str | Column, theta: float, offset: float = HIGH_OFFSET) -> Column:
    """High at theta + offset and above, Medium from theta, Low below; NULL probability has no tier."""
    m = micros(p)
    star, high = int(theta * 1_000_000 + 0.5), int((theta + offset) * 1_000_000 + 0.5)
    return F.when(m >= high, "High").when(m >= star, "Medium").when(m.isNotNull(), "Low")


def tier_distribution(tiered: DataFrame, tier: str = "risk_tier") -> DataFrame:
    """Rows and share per tier; the total comes from the three tier rows, not from a second scan."""
    rows = tiered.groupBy(tier).agg(F.count("*").alias("n"))
    folded = rows.agg(F.collect_list(F.struct(tier, "n")).alias("tiers"), F.sum("n").alias("total"))
    return folded.select("total", F.inline("tiers")).select(
        tier, F.col("n").alias("count"), snap(F.col("n") * 100.0 / F.col("total")).alias("pct")
    )


def dominant_features(contributions: str | Column, threshold: float = DOMINANCE) -> Column:
    """Sorted names of features whose attribution exceeds the threshold in size."""
    arr = F.col(contributions) if isinstance(contributions, str) else contributions
    return F.sort_array(F.transform(
        F.filter(arr, lambda c: F.abs(c["shap_value"]) > threshold), lambda c: c["feature"]
    ))


def recommend(df: DataFrame, dominant: str = "dominant_features", tier: str = "risk_tier",
              anomaly: str | None = None, probability: str | None = None) -> DataFrame:
    """Add rule_id, action, rationale and the matched features; the first matching rule wins."""
    rank = F.coalesce(*[F.when(F.col(tier) == t, r) for t, r in TIER_RANK.items()], F.lit(0))
    names = F.col(dominant)
    choice = None

    def rule(rule_id: str, action: str, rationale: str, matched: Column) -> Column:
        return F.struct(F.lit(rule_id).alias("rule_id"), F.lit(action).alias("action"),
                        F.lit(rationale).alias("rationale"), matched.alias("matched_features"))

    def when(cond: Column, value: Column) -> Column:
        return F.when(cond, value) if choice is None else choice.when(cond, value)

    if anomaly and probability:
        choice = when((F.col(anomaly) > 0.8) & (F.col(probability) < 0.5), rule(*DISCORDANCE, names))
    for rule_id, features, lowest, action, rationale in ACTION_RULES:
        wanted = F.array(*map(F.lit, features))
        cond = (rank >= TIER_RANK[lowest]) & F.arrays_overlap(names, wanted)
        choice = when(cond, rule(rule_id, action, rationale, F.sort_array(F.array_intersect(names, wanted))))
    choice = when(F.size(names) == 0, rule(*DIFFUSE, names)).otherwise(rule(*DEFAULT, names))
    return df.withColumn("_choice", choice).select("*", "_choice.*").drop("_choice")
