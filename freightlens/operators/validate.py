"""Strict validation: column rules that collect the errors of each row, then a split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from freightlens.session import stage
from freightlens.sources.shipments import DOUBLE_COLUMNS, ID, INT_COLUMNS, OPTIONAL_COLUMNS, ORDERED_COLUMNS

# Inclusive bounds per column; product_volume_l must be above zero.
RANGES = {
    "transit_days": (0, None), "door_opens": (0, None), "leg_count": (1, 3), "temp_std_c": (0, None),
    "temp_recovery_rate": (0, None), "rh_mean": (0, 1), "rh_std": (0, None), "rh_max": (0, 1),
    "package_type": (0, 2), "fill_ratio": (0, 1), "carrier_id": (0, None), "origin_zone": (0, None),
    "dest_zone": (0, None), "sensor_gap_hours": (0, None), "vibration_index": (0, None),
    "feature_x3": (0, 1), "silent_failure": (0, 1),
}
POSITIVE = ["product_volume_l"]


def _blank(name: str) -> Column:
    c = F.trim(F.col(name))
    return F.col(name).isNull() | (c == "") | (F.lower(c) == "nan")


def typed(name: str) -> Column:
    """The cell in its declared type, NULL when missing, NaN or not convertible; `2.5` is not an integer."""
    if name == ID:
        return F.col(name)
    if name in INT_COLUMNS:
        return F.col(name).try_cast("int")
    return F.nullif(F.col(name).try_cast("double"), F.lit(float("nan")))


def type_errors(value) -> list[Column]:
    """One code per cell: `type:x` for text that is not of the declared type, `missing:x` for a required blank."""
    out = [F.when(F.coalesce(F.length(value(ID)), F.lit(0)) < 1, F.lit(f"missing:{ID}"))]
    for name in ORDERED_COLUMNS[1:]:
        absent = F.lit(None).cast("string") if name in OPTIONAL_COLUMNS else F.lit(f"missing:{name}")
        out.append(F.when(value(name).isNull(), F.when(_blank(f"_raw.{name}"), absent).otherwise(F.lit(f"type:{name}"))))
    return out


def range_errors(value=F.col) -> list[Column]:
    out = []
    for name, (low, high) in RANGES.items():
        bad = value(name) < low
        if high is not None:
            bad = bad | (value(name) > high)
        out.append(F.when(bad, F.lit(f"range:{name}")))
    out += [F.when(value(name) <= 0, F.lit(f"range:{name}")) for name in POSITIVE]
    return out


def cross_errors(value=F.col) -> list[Column]:
    return [F.when(value("temp_max_c") < value("temp_min_c"), F.lit("cross:temp_max_lt_min"))]


def annotate(raw: DataFrame) -> DataFrame:
    """Typed columns plus `_errors`, the codes of every broken rule; works on batch and streaming rows alike."""
    rows = raw.select(*[typed(c).alias(c) for c in ORDERED_COLUMNS], F.struct(*ORDERED_COLUMNS).alias("_raw"))
    rules = [*type_errors(F.col), *range_errors(), *cross_errors()]
    found = F.sort_array(F.array_compact(F.array(*rules)))
    # A one-element generator computes the list once per row; a plain column would be copied, with all its
    # rules, into every filter that later readers put on it.
    return rows.select("*", F.explode_outer(F.array(found)).alias("_errors"))


def valid_rows(annotated: DataFrame) -> DataFrame:
    return annotated.where(F.size("_errors") == 0).select(*ORDERED_COLUMNS)


def quarantined_rows(annotated: DataFrame) -> DataFrame:
    """Untouched raw cells and the reasons for rejection."""
    return annotated.where(F.size("_errors") > 0).select("_raw.*", "_errors")


def error_counts(annotated: DataFrame, kind: str) -> DataFrame:
    """Rows per rule of one kind: `type`, `missing`, `range` or `cross`."""
    hits = annotated.select(F.explode_outer("_errors").alias("rule")).where(F.col("rule").startswith(kind + ":"))
    return hits.groupBy("rule").agg(F.count("*").alias("n_rows"))


def quarantine_summary(annotated: DataFrame, sample: int = 5) -> DataFrame:
    """One row: valid and quarantined counts and the first `sample` rejected ids.

    The rules run once: ids and reasons are written, and counts and a per-task top-n read them, so quarantined rows
    are not gathered.
    """
    narrow = stage(annotated.select(F.col("_raw")[ID].alias("id"), "_errors"), "annotated")
    counts = narrow.agg(
        F.count_if(F.size("_errors") == 0).alias("n_valid"), F.count_if(F.size("_errors") > 0).alias("n_quarantined")
    )
    first = (
        narrow.where(F.size("_errors") > 0).select(F.struct("id", F.concat_ws(",", "_errors").alias("errors")).alias("r"))
        .orderBy("r").limit(sample).agg(F.sort_array(F.collect_list("r")).alias("s"))
    )
    merged = counts.unionByName(first, allowMissingColumns=True).agg(
        F.max("n_valid").alias("n_valid"), F.max("n_quarantined").alias("n_quarantined"), F.first("s", True).alias("s")
    )
    return merged.select(
        "n_valid", "n_quarantined",
        F.concat_ws(";", F.transform("s", lambda r: F.concat_ws("=", r["id"], r["errors"]))).alias("first_rows"),
    )


def dedupe_exact(df: DataFrame) -> DataFrame:
    """One copy of each distinct row; copies collapse in the map-side combine before the shuffle."""
    return df.dropDuplicates()
