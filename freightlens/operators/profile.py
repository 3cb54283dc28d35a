"""Data profiling: wide aggregates, unpivoted to one row per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from freightlens.functions.quantiles import exact_quantiles
from freightlens.functions.scalars import ratio, snap, unpivot_cells, unpivot_structs
from freightlens.operators.features import numeric_columns
from freightlens.sources.shipments import ID, TARGET

MISSING_LIMIT = 0.05
EXPECTED_PREVALENCE, DRIFT_TOLERANCE = 0.1968, 0.05


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_cols"), F.lit(",".join(df.columns)).alias("columns")
    )


def missingness(df: DataFrame, limit: float = MISSING_LIMIT) -> DataFrame:
    """Columns with missing cells: count, percent, and whether the share exceeds the limit."""
    wide = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = [F.struct(F.lit(c).alias("column"), F.col(c).alias("missing_count"), F.col("_n").alias("n")) for c in df.columns]
    share = ratio(F.col("missing_count"), F.col("n"))
    return wide.select(unpivot_structs(rows)).where("missing_count > 0").select(
        "column", "missing_count", snap(share * 100.0).alias("missing_pct"), (share > limit).alias("flagged")
    )


def duplicates(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of equal rows; missing cells are equal to each other."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("_copies"))
    return groups.agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("full_row_duplicates"))


def identifier(df: DataFrame, column: str = ID) -> DataFrame:
    if column not in df.columns:
        return df.agg(F.count("*").alias("n")).select(
            F.lit(column).alias("column"), F.lit(None).cast("boolean").alias("is_unique"), F.lit(None).cast("bigint").alias("n_unique")
        )
    groups = df.groupBy(column).agg(F.count("*").alias("n"))
    return groups.agg(
        (F.max("n") <= 1).alias("is_unique"), F.count_if(F.col(column).isNotNull()).alias("n_unique")
    ).select(F.lit(column).alias("column"), "is_unique", "n_unique")


def target_audit(df: DataFrame, expected: float = EXPECTED_PREVALENCE, tolerance: float = DRIFT_TOLERANCE,
                 target: str = TARGET) -> DataFrame:
    wide = df.agg(
        F.count("*").alias("n"), F.count_if(F.col(target) == 1).alias("n_positive"), F.count_if(F.col(target) == 0).alias("n_negative")
    ).withColumn("prevalence", snap(ratio(F.col("n_positive"), F.col("n")), 10_000))
    drift = F.abs(F.col("prevalence") - expected)
    return wide.select(
        "n_positive", "n_negative", "prevalence", F.lit(expected).alias("expected_prevalence"),
        snap(drift).alias("drift_from_expected"), (drift > tolerance).alias("drift_alert"),
    )


def _sample_skew(c: Column, n: Column) -> Column:
    g = F.skewness(c)
    return F.when(n > 2, g * F.sqrt(n * (n - 1.0)) / (n - 2.0))


def _sample_kurtosis(c: Column, n: Column) -> Column:
    g = F.kurtosis(c)
    return F.when(n > 3, ((n + 1.0) * g + 6.0) * (n - 1.0) / ((n - 2.0) * (n - 3.0)))


def descriptive(df: DataFrame, columns: list[str] | None = None, staged: bool = False) -> DataFrame:
    """Mean, deviation, quartiles, extremes and bias-corrected shape of each numeric column.

    Cells are unpivoted before they are aggregated: one small set of moment states per column
    stays in generated code, where a single row of 150 states does not. Quartiles come from the
    exact-quantile job.
    """
    columns = columns or [n for n, t in df.dtypes if t in ("int", "bigint", "double", "float") and n != ID]
    quartiles = exact_quantiles(df, {c: F.col(c) for c in columns}, [0.25, 0.5, 0.75], staged=staged)
    known = F.create_map(*[x for c in columns for x in (F.lit(c), F.array(*[F.lit(q).cast("double") for q in quartiles[c]]))])
    v = F.col("value")
    n = F.count(v).cast("double")
    moments = unpivot_cells(df, columns).groupBy("column").agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        _sample_skew(v, n).alias("skew"), _sample_kurtosis(v, n).alias("kurtosis"),
    )
    quartile = lambda i: F.get(F.element_at(known, F.col("column")), F.lit(i))
    return moments.select(
        "column", snap("mean").alias("mean"), snap("std").alias("std"), snap("min").alias("min"),
        snap(quartile(0)).alias("q25"), snap(quartile(1)).alias("q50"), snap(quartile(2)).alias("q75"),
        snap("max").alias("max"), snap("skew").alias("skew"), snap("kurtosis").alias("kurtosis"),
    )


def range_violations(df: DataFrame) -> DataFrame:
    """Physically impossible values; only checks that fail are listed."""
    c = F.col
    checks = {
        "fill_ratio_out_of_range": (c("fill_ratio") < 0) | (c("fill_ratio") > 1),
        "rh_mean_out_of_range": (c("rh_mean") < 0) | (c("rh_mean") > 1),
        "temp_max_lt_min": c("temp_max_c") < c("temp_min_c"),
    }
    wide = df.agg(*[F.count_if(v).alias(k) for k, v in checks.items()])
    return wide.select(unpivot_structs(
        [F.struct(F.lit(k).alias("check"), F.col(k).alias("n_rows")) for k in checks]
    )).where("n_rows > 0")


def failure_rate_by_segment(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Failure share per carrier, origin and destination from one scan.

    Each row is first combined into its (carrier, origin, destination) cell before the grouping
    sets expand it, so the expansion works on a few hundred cells instead of all rows.
    """
    keys = ["carrier_id", "origin_zone", "dest_zone"]
    cells = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(target).alias("failures"))
    sets = cells.groupingSets([[F.col(k)] for k in keys], *keys).agg(
        F.sum("n").alias("n_shipments"), F.sum("failures").alias("n_failures"),
        *[F.grouping(k).alias(f"g_{k}") for k in keys],
    )
    kind = F.when(F.col("g_carrier_id") == 0, "carrier_id").when(F.col("g_origin_zone") == 0, "origin_zone").otherwise("dest_zone")
    return sets.select(
        kind.alias("segment"), F.coalesce(*keys).alias("level"), "n_shipments", "n_failures",
        snap(F.col("n_failures") * 100.0 / F.col("n_shipments")).alias("failure_pct"),
    )


def full_report(df: DataFrame, staged: bool = False) -> DataFrame:
    """Everything above as (section, item, value) rows, ready for one JSON report."""
    def long(section: str, part: DataFrame, item: str | None) -> DataFrame:
        values = [n for n in part.columns if n != item]
        return part.select(
            F.lit(section).alias("section"), (F.col(item) if item else F.lit("")).cast("string").alias("item"),
            F.inline(F.array(*[
                F.struct(F.lit(v).alias("stat"), F.col(v).cast("double").alias("value")) for v in values
            ])),
        )

    parts = [
        long("shape", shape(df).drop("columns"), None), long("missingness", missingness(df), "column"),
        long("duplicates", duplicates(df), None), long("identifier", identifier(df).drop("column"), None),
        long("target", target_audit(df), None), long("descriptive", descriptive(df, staged=staged), "column"),
        long("range_violations", range_violations(df), "check"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def save_report(report: DataFrame, path: str) -> None:
    """The report has a bounded number of rows and becomes one JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)
