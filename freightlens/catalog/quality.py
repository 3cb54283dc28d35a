"""Queries on intake quality: scan, validation, profiling, de-duplication."""

from pyspark.sql import functions as F

from freightlens.catalog.registry import query
from freightlens.catalog.views import ORDERED, RAW, over, snap
from freightlens.operators import profile, validate
from freightlens.plans.scoring import staged_shipments
from freightlens.session import new_folder, stage
from freightlens.sources.shipments import ORDERED_COLUMNS, raw_shipments, read_raw_csv, shipments, write_csv

INTS = "door_opens leg_count package_type carrier_id origin_zone dest_zone feature_x3 silent_failure".split()
OPTIONAL = ["temp_recovery_rate", "rh_max"]


def _cell(c):
    return f"CASE WHEN trim({c})<>'' AND lower(trim({c}))<>'nan' THEN trim({c}) END"


def _typed(c):
    if c == "shipment_id":
        return "shipment_id"
    if c in INTS:
        return f"CASE WHEN regexp_full_match({_cell(c)}, '-?[0-9]+') THEN try_cast({_cell(c)} AS int) END"
    return f"try_cast({_cell(c)} AS double)"


def _sql_errors():
    out = ["CASE WHEN coalesce(length(r_shipment_id),0)<1 THEN 'missing:shipment_id' END"]
    for c in ORDERED[1:]:
        out.append(f"CASE WHEN {_cell('r_' + c)} IS NOT NULL AND {c} IS NULL THEN 'type:{c}' END")
        if c not in OPTIONAL:
            out.append(f"CASE WHEN {_cell('r_' + c)} IS NULL THEN 'missing:{c}' END")
    for c, (lo, hi) in validate.RANGES.items():
        out.append(f"CASE WHEN {c}<{lo}{f' OR {c}>{hi}' if hi is not None else ''} THEN 'range:{c}' END")
    out.append("CASE WHEN product_volume_l<=0 THEN 'range:product_volume_l' END")
    out.append("CASE WHEN temp_max_c<temp_min_c THEN 'cross:temp_max_lt_min' END")
    return ", ".join(out)


CHECKED = (
    "typed AS (SELECT k, " + ", ".join(f"{_typed(c)} AS {c}, {c} AS r_{c}" for c in ORDERED) + " FROM raw),\n"
    f"checked AS (SELECT *, list_sort(list_filter([{_sql_errors()}], lambda x: x IS NOT NULL)) AS errors FROM typed)"
)
RULES = "rules AS (SELECT unnest(errors) AS rule FROM checked)"


def _rules_sql(kind):
    return over(
        f"SELECT rule, count(*) AS n_rows FROM rules WHERE starts_with(rule, '{kind}') GROUP BY rule", RAW, CHECKED, RULES
    )


@query("scan_shipments", over("SELECT * FROM shipments"))
def scan_shipments(spark, sf):
    return shipments(spark, sf)


def _landed(spark, sf):
    """The untrusted rows as a landed table, for queries that read them several times."""
    return stage(raw_shipments(spark, sf), "landing")


def _annotated(spark, sf):
    return validate.annotate(raw_shipments(spark, sf))


@query("validate_types", over(
    "SELECT rule, count(*) AS n_rows FROM rules WHERE starts_with(rule,'type:') OR starts_with(rule,'missing:') GROUP BY rule",
    RAW, CHECKED, RULES))
def validate_types(spark, sf):
    rows = _annotated(spark, sf).select(F.explode_outer("_errors").alias("rule"))
    return rows.where(F.col("rule").rlike("^(type|missing):")).groupBy("rule").agg(F.count("*").alias("n_rows"))


@query("validate_ranges", _rules_sql("range:"))
def validate_ranges(spark, sf):
    return validate.error_counts(_annotated(spark, sf), "range")


@query("validate_cross_field", _rules_sql("cross:"))
def validate_cross_field(spark, sf):
    return validate.error_counts(_annotated(spark, sf), "cross")


@query("quarantine_split", over(
    "SELECT " + ", ".join(f"r_{c} AS {c}" for c in ("shipment_id", "leg_count", "door_opens"))
    + ", array_to_string(errors, ',') AS errors FROM checked WHERE len(errors)>0", RAW, CHECKED))
def quarantine_split(spark, sf):
    bad = validate.quarantined_rows(_annotated(spark, sf))
    return bad.select("shipment_id", "leg_count", "door_opens", F.concat_ws(",", "_errors").alias("errors"))


@query("valid_shipments", over(
    "SELECT " + ", ".join(ORDERED) + " FROM checked WHERE len(errors)=0", RAW, CHECKED))
def valid_shipments(spark, sf):
    return validate.valid_rows(_annotated(spark, sf))


@query("quarantine_summary", over(
    """SELECT (SELECT count(*) FROM checked WHERE len(errors)=0) AS n_valid,
  (SELECT count(*) FROM checked WHERE len(errors)>0) AS n_quarantined,
  (SELECT string_agg(id || '=' || e, ';' ORDER BY id, e) FROM
     (SELECT r_shipment_id AS id, array_to_string(errors, ',') AS e FROM checked WHERE len(errors)>0 ORDER BY id, e LIMIT 5)) AS first_rows""",
    RAW, CHECKED))
def quarantine_summary(spark, sf):
    return validate.quarantine_summary(_annotated(spark, sf))


@query("csv_intake", over("SELECT rule, count(*) AS n_rows FROM rules GROUP BY rule", RAW, CHECKED, RULES))
def csv_intake(spark, sf):
    """The untrusted rows as CSV files, scanned as text, validated, and their errors counted."""
    path = new_folder(spark, "intake")
    write_csv(raw_shipments(spark, sf), path)
    errors = validate.annotate(read_raw_csv(spark, path)).select(F.explode("_errors").alias("rule"))
    return errors.groupBy("rule").agg(F.count("*").alias("n_rows"))


TYPED_ONLY = "typed0 AS (SELECT " + ", ".join(f"{_typed(c)} AS {c}" for c in ORDERED) + " FROM raw)"


def _typed_rows(spark, sf):
    return validate.annotate(_landed(spark, sf)).select(*ORDERED_COLUMNS)


@query("range_violations", over(
    """SELECT * FROM (SELECT 'fill_ratio_out_of_range' AS "check", count(*) FILTER (fill_ratio<0 OR fill_ratio>1) AS n_rows FROM typed0
  UNION ALL SELECT 'rh_mean_out_of_range', count(*) FILTER (rh_mean<0 OR rh_mean>1) FROM typed0
  UNION ALL SELECT 'temp_max_lt_min', count(*) FILTER (temp_max_c<temp_min_c) FROM typed0) WHERE n_rows>0""", RAW, TYPED_ONLY))
def range_violations(spark, sf):
    return profile.range_violations(_typed_rows(spark, sf))


@query("profile_shape", over(f"SELECT count(*) AS n_rows, cast({len(ORDERED)} AS bigint) AS n_cols, '{','.join(ORDERED)}' AS columns FROM shipments"))
def profile_shape(spark, sf):
    return profile.shape(shipments(spark, sf))


def _missing_sql(source):
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS missing_count, count(*) AS n FROM {source}" for c in ORDERED
    )
    return (f"SELECT \"column\", missing_count, {snap('cast(missing_count AS double)/n*100.0')} AS missing_pct, "
            f"cast(missing_count AS double)/n > 0.05 AS flagged FROM ({parts}) WHERE missing_count>0")


@query("profile_missingness", over(_missing_sql("typed0"), RAW, TYPED_ONLY))
def profile_missingness(spark, sf):
    return profile.missingness(_typed_rows(spark, sf))


@query("profile_duplicates", over(
    "SELECT cast((SELECT count(*) FROM typed0) - (SELECT count(*) FROM (SELECT DISTINCT * FROM typed0)) AS bigint) AS full_row_duplicates",
    RAW, TYPED_ONLY))
def profile_duplicates(spark, sf):
    return profile.duplicates(_typed_rows(spark, sf))


@query("dedupe_exact", over("SELECT DISTINCT * FROM typed0", RAW, TYPED_ONLY))
def dedupe_exact(spark, sf):
    return validate.dedupe_exact(_typed_rows(spark, sf))


@query("profile_identifier", over(
    "SELECT 'shipment_id' AS \"column\", count(*)=count(DISTINCT shipment_id) AS is_unique, count(DISTINCT shipment_id) AS n_unique FROM typed0",
    RAW, TYPED_ONLY))
def profile_identifier(spark, sf):
    return profile.identifier(_typed_rows(spark, sf))


TARGET_SQL = """SELECT n_positive, n_negative, prevalence, cast(0.1968 AS double) AS expected_prevalence,
  floor(abs(prevalence-cast(0.1968 AS double))*1000000+0.5)/1000000 AS drift_from_expected,
  abs(prevalence-cast(0.1968 AS double)) > cast(0.05 AS double) AS drift_alert FROM (
  SELECT count(*) FILTER (silent_failure=1) AS n_positive, count(*) FILTER (silent_failure=0) AS n_negative,
    floor(cast(count(*) FILTER (silent_failure=1) AS double)/count(*)*10000+0.5)/10000 AS prevalence FROM shipments)"""


@query("target_drift", over(TARGET_SQL))
def target_drift(spark, sf):
    return profile.target_audit(shipments(spark, sf))


NUMERIC = [c for c in ORDERED if c != "shipment_id"]


def _descriptive_sql():
    parts = []
    for c in NUMERIC:
        x = f"cast({c} AS double)"
        parts.append(
            f"SELECT '{c}' AS \"column\", {snap(f'avg({x})')} AS mean, {snap(f'stddev_samp({x})')} AS std, {snap(f'min({x})')} AS min, "
            + ", ".join(f"{snap(f'quantile_cont({x}, {q})')} AS q{n}" for q, n in ((0.25, 25), (0.5, 50), (0.75, 75)))
            + f", {snap(f'max({x})')} AS max, {snap(f'skewness({x})')} AS skew, {snap(f'kurtosis({x})')} AS kurtosis FROM shipments")
    return " UNION ALL ".join(parts)


@query("profile_descriptive", over(_descriptive_sql()))
def profile_descriptive(spark, sf):
    return profile.descriptive(staged_shipments(spark, sf), staged=True)


@query("profile_report", over(f"""SELECT section, item, stat, cast(value AS double) AS value FROM (
 SELECT 'shape' AS section, '' AS item, 'n_rows' AS stat, count(*) AS value FROM shipments
 UNION ALL SELECT 'shape','','n_cols', {len(ORDERED)}
 UNION ALL SELECT 'duplicates','','full_row_duplicates', (SELECT count(*) FROM shipments) - (SELECT count(*) FROM (SELECT DISTINCT * FROM shipments))
 UNION ALL SELECT 'missingness', "column", unnest(['missing_count','missing_pct','flagged']),
    unnest([cast(missing_count AS double), missing_pct, CASE WHEN flagged THEN 1.0 ELSE 0.0 END]) FROM miss
 UNION ALL SELECT 'identifier','', unnest(['is_unique','n_unique']),
    unnest([CASE WHEN count(*)=count(DISTINCT shipment_id) THEN 1.0 ELSE 0.0 END, count(DISTINCT shipment_id)]) FROM shipments
 UNION ALL SELECT 'target','', unnest(['n_positive','n_negative','prevalence','expected_prevalence','drift_from_expected','drift_alert']),
    unnest([n_positive, n_negative, prevalence, expected_prevalence, drift_from_expected, CASE WHEN drift_alert THEN 1.0 ELSE 0.0 END]) FROM tgt
 UNION ALL SELECT 'descriptive', "column", unnest(['mean','std','min','q25','q50','q75','max','skew','kurtosis']),
    unnest([mean,std,min,q25,q50,q75,max,skew,kurtosis]) FROM des
 UNION ALL SELECT 'range_violations', 'temp_max_lt_min', 'n_rows', n FROM (SELECT count(*) AS n FROM shipments WHERE temp_max_c<temp_min_c) WHERE n>0
 UNION ALL SELECT 'range_violations', 'fill_ratio_out_of_range', 'n_rows', n FROM (SELECT count(*) AS n FROM shipments WHERE fill_ratio<0 OR fill_ratio>1) WHERE n>0
 UNION ALL SELECT 'range_violations', 'rh_mean_out_of_range', 'n_rows', n FROM (SELECT count(*) AS n FROM shipments WHERE rh_mean<0 OR rh_mean>1) WHERE n>0
)""", f"miss AS ({_missing_sql('shipments')})", f"tgt AS ({TARGET_SQL})", f"des AS ({_descriptive_sql()})"))
def profile_report(spark, sf):
    return profile.full_report(staged_shipments(spark, sf), staged=True)


@query("failure_rate_by_segment", over(" UNION ALL ".join(
    f"SELECT '{k}' AS segment, {k} AS level, count(*) AS n_shipments, cast(sum(silent_failure) AS bigint) AS n_failures, "
    f"{snap('sum(silent_failure)*cast(100 AS double)/count(*)')} AS failure_pct FROM shipments GROUP BY {k}"
    for k in ("carrier_id", "origin_zone", "dest_zone"))))
def failure_rate_by_segment(spark, sf):
    return profile.failure_rate_by_segment(shipments(spark, sf))
