"""Statistic-based imputation: class-conditional and global medians."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from freightlens.functions.quantiles import exact_quantiles
from freightlens.sources.shipments import TARGET

IMPUTED = ["rh_max", "temp_recovery_rate"]
# The related columns that stand in for a missing one.
FALLBACK_FEATURES = {
    "rh_max": ["rh_mean", "rh_std", "temp_mean_c"],
    "temp_recovery_rate": ["temp_mean_c", "temp_std_c", "transit_days"],
}


def fit_class_medians(df: DataFrame, columns=IMPUTED, label: str = TARGET, staged: bool = False) -> dict[str, dict[int, float]]:
    """{column: {class: median}} for the two classes in one pass."""
    per_class = {f"{c}__{k}": F.when(F.col(label) == k, F.col(c)) for c in columns for k in (0, 1)}
    got = exact_quantiles(df, per_class, [0.5], staged=staged)
    return {c: {k: got[f"{c}__{k}"][0] for k in (0, 1)} for c in columns}


def fill_class_medians(df: DataFrame, medians: dict[str, dict[int, float]], label: str = TARGET) -> DataFrame:
    """Own-class median for missing cells; rows without a usable label get the median of class 0."""
    y = F.col(label)
    return df.withColumns({
        c: F.coalesce(F.col(c), F.when(y == 1, F.lit(m[1])).when(y == 0, F.lit(m[0])), F.lit(m[0]))
        for c, m in medians.items()
    })


def fit_medians(df: DataFrame, columns=IMPUTED, staged: bool = False) -> dict[str, float]:
    got = exact_quantiles(df, {c: F.col(c) for c in columns}, [0.5], staged=staged)
    return {c: v[0] for c, v in got.items()}


def fill_medians(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("double") if kinds[c] != "double" else F.col(c), F.lit(m))
        for c, m in medians.items() if m is not None and c in kinds
    })
