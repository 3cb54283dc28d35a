"""Engineered features, feature sets, scaling and feature-target correlation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from freightlens.functions.scalars import ratio_or_zero, snap, unpivot_cells
from freightlens.sources.shipments import ID, TARGET

# The groups of raw columns, the engineered columns, and the feature sets built from them.
RAW_GROUPS = {
    "transit": ["transit_days", "door_opens", "leg_count"],
    "temperature": ["temp_mean_c", "temp_max_c", "temp_min_c", "temp_std_c", "temp_recovery_rate"],
    "humidity": ["rh_mean", "rh_std", "rh_max"],
    "packaging": ["package_type", "product_volume_l", "fill_ratio"],
    "routing": ["carrier_id", "origin_zone", "dest_zone"],
    "sensor": ["sensor_gap_hours", "vibration_index"],
    "anonymized": ["feature_x1", "feature_x2", "feature_x3"],
}
RAW_FEATURES = [c for group in RAW_GROUPS.values() for c in group]
CORE = ["temp_range_c", "excursion_intensity", "vibration_rate", "rh_range"]
DOOR_RATE = ["door_open_rate"]
LOGS = ["log1p_transit_days", "log1p_sensor_gap_hours", "log1p_door_opens"]
INTERACTIONS = ["transit_x_temp_range", "door_x_sensor_gap", "rh_range_x_temp_range"]
CATEGORICAL = ["carrier_id", "origin_zone", "dest_zone", "package_type", "leg_count", "feature_x3"]

FEATURE_SETS = {
    "FS-A": RAW_FEATURES,
    "FS-B": RAW_FEATURES + CORE,
    "FS-C": RAW_FEATURES + CORE + DOOR_RATE,
    "FS-D": RAW_FEATURES + CORE + LOGS,
    "FS-E": RAW_FEATURES + CORE + INTERACTIONS,
    "FS-F": RAW_FEATURES + CORE + DOOR_RATE + LOGS + INTERACTIONS,
}

# Wording shown next to each feature in explanations.
DESCRIPTIONS = [
    ("transit_days", "transit", "raw", "Total transit duration (days)"),
    ("door_opens", "transit", "raw", "Number of door-opening events"),
    ("leg_count", "transit", "raw", "Number of routing legs (1–3)"),
    ("temp_mean_c", "temperature", "raw", "Mean temperature (°C)"),
    ("temp_max_c", "temperature", "raw", "Maximum temperature (°C)"),
    ("temp_min_c", "temperature", "raw", "Minimum temperature (°C)"),
    ("temp_std_c", "temperature", "raw", "Temperature std deviation (°C)"),
    ("temp_recovery_rate", "temperature", "raw", "Temp recovery rate after excursion"),
    ("temp_range_c", "temperature", "engineered", "Temperature range (max − min)"),
    ("rh_mean", "humidity", "raw", "Mean relative humidity (0–1)"),
    ("rh_std", "humidity", "raw", "Humidity std deviation"),
    ("rh_max", "humidity", "raw", "Maximum relative humidity (0–1)"),
    ("rh_range", "humidity", "engineered", "Humidity range (max − mean)"),
    ("package_type", "packaging", "raw", "Package type code (0/1/2)"),
    ("product_volume_l", "packaging", "raw", "Product volume (litres)"),
    ("fill_ratio", "packaging", "raw", "Container fill ratio (0–1)"),
    ("carrier_id", "routing", "raw", "Carrier identifier"),
    ("origin_zone", "routing", "raw", "Origin zone code"),
    ("dest_zone", "routing", "raw", "Destination zone code"),
    ("sensor_gap_hours", "sensor", "raw", "Max gap between sensor reads (hours)"),
    ("vibration_index", "sensor", "raw", "Cumulative vibration index"),
    ("vibration_rate", "sensor", "engineered", "Vibration intensity (index / days)"),
    ("feature_x1", "anonymized", "raw", "Anonymized covariate 1"),
    ("feature_x2", "anonymized", "raw", "Anonymized covariate 2"),
    ("feature_x3", "anonymized", "raw", "Anonymized binary covariate 3"),
    ("excursion_intensity", "composite", "engineered",
     "Composite excursion severity (0.4×z_temp_range + 0.6×z_sensor_gap)"),
    ("door_open_rate", "transit", "engineered", "Door opens / transit days (NEGATIVE RESULT — reduces signal vs raw)"),
    ("log1p_transit_days", "transit", "engineered", "log1p(transit_days) for skew reduction"),
    ("log1p_sensor_gap_hours", "sensor", "engineered", "log1p(sensor_gap_hours) for skew reduction"),
    ("log1p_door_opens", "transit", "engineered", "log1p(door_opens) for skew reduction"),
    ("transit_x_temp_range", "interaction", "engineered", "transit_days × temp_range_c"),
    ("door_x_sensor_gap", "interaction", "engineered", "door_opens × sensor_gap_hours"),
    ("rh_range_x_temp_range", "interaction", "engineered", "rh_range × temp_range_c"),
]


def numeric_columns(df: DataFrame, *exclude: str) -> list[str]:
    """Numeric columns of `df` in order, without the identifier, the target and `exclude`."""
    skip = {ID, TARGET, *exclude}
    return [n for n, t in df.dtypes if t in ("int", "bigint", "double", "float") and n not in skip]


def feature_set(name: str) -> list[str]:
    if name not in FEATURE_SETS:
        raise ValueError(f"unknown feature set {name!r}; options: {sorted(FEATURE_SETS)}")
    return FEATURE_SETS[name]


def select_features(df: DataFrame, name: str) -> DataFrame:
    """Identifier, the columns of the set that are present, and the target."""
    have = set(df.columns)
    keep = [c for c in feature_set(name) if c in have]
    return df.select(*[c for c in (ID, *keep, TARGET) if c in have])


def with_descriptions(df: DataFrame, column: str = "feature") -> DataFrame:
    """Add family and description of the named feature; unknown names describe themselves."""
    words = df.sparkSession.createDataFrame(DESCRIPTIONS, f"{column} string, _f string, _t string, _d string")
    return (
        df.join(F.broadcast(words), column, "left")
        .withColumn("family", F.coalesce("_f", F.lit("unknown")))
        .withColumn("description", F.coalesce("_d", F.col(column)))
        .drop("_f", "_t", "_d")
    )


@dataclass(frozen=True)
class ExcursionScaler:
    """Mean and sample deviation of temperature range and sensor gap, learned on training rows."""

    range_mean: float
    range_std: float
    gap_mean: float
    gap_std: float
    range_weight: float = 0.4
    gap_weight: float = 0.6


def fit_excursion(df: DataFrame, range_weight: float = 0.4, gap_weight: float = 0.6) -> ExcursionScaler:
    span = F.col("temp_max_c") - F.col("temp_min_c")
    row = df.agg(
        F.avg(span), F.stddev_samp(span), F.avg("sensor_gap_hours"), F.stddev_samp("sensor_gap_hours")
    ).first()
    return ExcursionScaler(*[0.0 if v is None else float(v) for v in row], range_weight, gap_weight)


def engineer(df: DataFrame, scaler: ExcursionScaler) -> DataFrame:
    """Add all engineered columns; the optimiser drops those that nobody reads."""
    c = F.col
    z = lambda x, mean, std: (x - F.lit(mean)) / F.lit(std if std else 1.0)
    df = df.withColumns({
        "temp_range_c": c("temp_max_c") - c("temp_min_c"),
        "vibration_rate": ratio_or_zero(c("vibration_index"), c("transit_days")),
        "rh_range": c("rh_max") - c("rh_mean"),
        "door_open_rate": ratio_or_zero(c("door_opens"), c("transit_days")),
        **{f"log1p_{n}": F.log1p(n) for n in ("transit_days", "sensor_gap_hours", "door_opens")},
        "door_x_sensor_gap": c("door_opens") * c("sensor_gap_hours"),
    })
    return df.withColumns({
        "excursion_intensity": F.lit(scaler.range_weight) * z(c("temp_range_c"), scaler.range_mean, scaler.range_std)
        + F.lit(scaler.gap_weight) * z(c("sensor_gap_hours"), scaler.gap_mean, scaler.gap_std),
        "transit_x_temp_range": c("transit_days") * c("temp_range_c"),
        "rh_range_x_temp_range": c("rh_range") * c("temp_range_c"),
    })


def fold_excursion(df: DataFrame, fold: str = "fold", range_weight: float = 0.4, gap_weight: float = 0.6) -> DataFrame:
    """excursion_intensity of each row scaled by the rows of the *other* folds.

    One aggregate per fold; the statistics of the training rows are total minus own fold, so
    rows are read once whatever the number of folds.
    """
    span, gap = F.col("temp_max_c") - F.col("temp_min_c"), F.col("sensor_gap_hours")
    def moments(x: Column) -> Column:
        n = F.count(x).cast("double")
        return F.struct(n.alias("n"), F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(x) * n, F.lit(0.0)).alias("m2"))

    own = df.groupBy(fold).agg(moments(span).alias("r"), moments(gap).alias("g"))
    folds = own.agg(F.sort_array(F.collect_list(F.struct(fold, "r", "g"))).alias("all"))  # one struct per fold

    def others(name: str) -> Column:
        """Count, mean and squared deviations of the other folds together, merged without large differences."""
        def merge(a: Column, x: Column) -> Column:
            b, n = x[name], a["n"] + x[name]["n"]
            away, share = b["mean"] - a["mean"], F.coalesce(F.try_divide(b["n"], n), F.lit(0.0))
            return F.struct(n.alias("n"), (a["mean"] + away * share).alias("mean"), (a["m2"] + b["m2"] + away * away * a["n"] * share).alias("m2"))

        zero = F.struct(*[F.lit(0.0).alias(k) for k in ("n", "mean", "m2")])
        return F.aggregate(F.filter("all", lambda x: x[fold] != F.col(fold)), zero, merge)

    c = F.col
    spread = lambda x: F.sqrt(F.try_divide(c(x)["m2"], c(x)["n"] - 1.0))
    stats = folds.select("all", F.explode(F.col(f"all.{fold}")).alias(fold)).select(fold, others("r").alias("r"), others("g").alias("g")).select(
        fold, c("r.mean").alias("rm"), spread("r").alias("rd"), c("g.mean").alias("gm"), spread("g").alias("gd"))
    z = lambda x, m, d: (x - c(m)) / F.when(c(d) == 0, F.lit(1.0)).otherwise(c(d))
    joined = df.join(F.broadcast(stats), fold)
    value = F.lit(range_weight) * z(c("temp_max_c") - c("temp_min_c"), "rm", "rd") + F.lit(gap_weight) * z(
        c("sensor_gap_hours"), "gm", "gd"
    )
    return joined.withColumn("excursion_intensity", value).drop("rm", "rd", "gm", "gd")


def fit_standard(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """{column: (mean, population deviation)}."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 0.0) for c in columns}


def standardize(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s if s else 1.0) for c, (m, s) in stats.items()})


def correlations(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Pearson r of every numeric column with the target over complete pairs, strongest first."""
    columns = numeric_columns(df, target)
    cells = unpivot_cells(df, columns, "feature", [F.col(target).cast("double").alias("_y")])
    found = cells.groupBy("feature").agg(snap(F.corr("value", "_y")).alias("pearson_r"))
    return found.withColumn("abs_r", F.abs("pearson_r")).orderBy(F.desc_nulls_last("abs_r"), "feature")
