"""Batch twins of the streaming operators; each uses the transform its stream uses."""

from pyspark.sql import functions as F

from freightlens.catalog.quality import CHECKED
from freightlens.catalog.registry import query
from freightlens.catalog.views import RAW, over, snap
from freightlens.functions.scalars import snap as snapped
from freightlens.operators import anomaly
from freightlens.operators.validate import annotate
from freightlens.session import stage
from freightlens.sources.shipments import raw_shipments
from freightlens.sources.telemetry import telemetry
from freightlens.streaming import telemetry as ops, trips

TEL = """WITH tel AS (SELECT event_id, ts, user_id AS device_id, CASE event_type WHEN 'view' THEN 'temperature' WHEN 'click' THEN 'humidity'
  WHEN 'error' THEN 'vibration' WHEN 'signup' THEN 'door' WHEN 'purchase' THEN 'location' ELSE 'other' END AS sensor, value AS reading, epoch_us(ts) AS us FROM events)"""


@query("stream_quarantine", over("SELECT rule, count(*) AS n_rows FROM (SELECT CASE WHEN len(errors)=0 THEN 'valid' ELSE 'quarantined' END AS rule FROM checked) GROUP BY rule", RAW, CHECKED))
def stream_quarantine(spark, sf):
    rows = annotate(stage(raw_shipments(spark, sf), "landing"))
    return rows.groupBy(F.when(F.size("_errors") == 0, "valid").otherwise("quarantined").alias("rule")).agg(F.count("*").alias("n_rows"))


@query("telemetry_rollup", TEL + f""", w AS (SELECT *, us//21600000000*21600 AS window_start,
  us-lag(us) OVER (PARTITION BY device_id, sensor, us//21600000000 ORDER BY us) AS gap FROM tel)
  SELECT device_id, sensor, window_start, count(*) AS n_readings, {snap('avg(reading)')} AS reading_mean, {snap('max(reading)')} AS reading_max,
  {snap('min(reading)')} AS reading_min, {snap('stddev_samp(reading)')} AS reading_std, {snap('coalesce(max(gap),0)/cast(3600000000 AS double)')} AS max_gap_hours
  FROM w GROUP BY device_id, sensor, window_start""")
def telemetry_rollup(spark, sf):
    return ops.rollup_with_gaps(telemetry(spark, sf))


@query("telemetry_sliding", TEL + f""" SELECT device_id, sensor, (us//10800000000 - k)*10800 AS window_start, count(*) AS n_readings, {snap('avg(reading)')} AS reading_mean,
  {snap('max(reading)')} AS reading_max, {snap('min(reading)')} AS reading_min, {snap('stddev_samp(reading)')} AS reading_std
  FROM tel, (SELECT unnest([0,1]) AS k) GROUP BY ALL""")
def telemetry_sliding(spark, sf):
    return ops.rollup(telemetry(spark, sf), "6 hours", "3 hours")


@query("rh_baseline_range", TEL + f""" SELECT device_id, min(reading) AS rh_baseline, max(reading) AS rh_peak, count(*) AS n_readings,
  {snap('max(reading)-min(reading)')} AS rh_range FROM tel WHERE sensor='humidity' GROUP BY device_id""")
def rh_baseline_range(spark, sf):
    return ops.humidity_range(telemetry(spark, sf))


@query("telemetry_sessions", TEL + """, g AS (SELECT *, CASE WHEN us-lag(us) OVER (PARTITION BY device_id ORDER BY us)<=21600000000 THEN 0 ELSE 1 END AS fresh FROM tel),
  n AS (SELECT *, sum(fresh) OVER (PARTITION BY device_id ORDER BY us RANGE UNBOUNDED PRECEDING) AS session FROM g)
  SELECT device_id, min(us) AS first_us, max(us) AS last_us, count(*) AS n_readings FROM n GROUP BY device_id, session""")
def telemetry_sessions(spark, sf):
    return ops.batch_sessions(telemetry(spark, sf))


@query("stream_dedupe", TEL + " SELECT event_id, device_id, sensor, reading FROM tel")
def stream_dedupe(spark, sf):
    """Readings sent again after a reconnect (here every tenth) are kept once."""
    again = F.when(F.col("event_id") % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    repeated = telemetry(spark, sf).withColumn("_copy", F.explode(again)).drop("_copy")
    return ops.dedupe(repeated).select("event_id", "device_id", "sensor", "reading")


@query("stream_rescore", TEL + f""" SELECT device_id, n_readings, p, CASE WHEN m>=650000 THEN 'High' WHEN m>=300000 THEN 'Medium' ELSE 'Low' END AS risk_tier FROM
  (SELECT *, cast(floor(p*1000000+0.5) AS bigint) AS m FROM (SELECT device_id, n_readings,
   {snap('1/(1+exp(-(cast(-3.0 AS double)+rm*cast(0.02 AS double)+rx*cast(0.004 AS double)+nv*cast(0.02 AS double))))')} AS p FROM
  (SELECT device_id, count(*) AS n_readings, avg(reading) AS rm, max(reading) AS rx, count(*) FILTER (sensor='vibration') AS nv FROM tel GROUP BY device_id)))""")
def stream_rescore(spark, sf):
    return ops.rescore(telemetry(spark, sf))


TRIPS_SQL = """, g AS (SELECT *, CASE WHEN us-lag(us) OVER (PARTITION BY device_id ORDER BY us)<=21600000000 THEN 0 ELSE 1 END AS fresh FROM tel),
  n AS (SELECT *, sum(fresh) OVER (PARTITION BY device_id ORDER BY us RANGE UNBOUNDED PRECEDING) AS trip FROM g)"""


@query("stream_window_gaps", TEL + f""", w AS (SELECT *, us//21600000000*21600 AS window_start,
  us-lag(us) OVER (PARTITION BY device_id, sensor, us//21600000000 ORDER BY us) AS gap FROM tel)
  SELECT device_id, sensor, window_start, {snap('coalesce(max(gap),0)/cast(3600000000 AS double)')} AS max_gap_hours
  FROM w GROUP BY device_id, sensor, window_start""")
def stream_window_gaps(spark, sf):
    return trips.stream_window_gaps(telemetry(spark, sf))


@query("stream_trip_rescore", TEL + TRIPS_SQL + f""" SELECT device_id, first_us, n_readings, p, CASE WHEN m>=650000 THEN 'High' WHEN m>=300000 THEN 'Medium' ELSE 'Low' END
  AS risk_tier, true AS closed FROM (SELECT *, cast(floor(p*1000000+0.5) AS bigint) AS m FROM (SELECT device_id, first_us, n_readings,
   {snap('1/(1+exp(-(cast(-3.0 AS double)+rm*cast(0.02 AS double)+rx*cast(0.004 AS double)+nv*cast(0.02 AS double))))')} AS p FROM
  (SELECT device_id, min(us) AS first_us, count(*) AS n_readings, avg(reading) AS rm, max(reading) AS rx, count(*) FILTER (sensor='vibration') AS nv
   FROM n GROUP BY device_id, trip)))""")
def stream_trip_rescore(spark, sf):
    return trips.rescore_trips(telemetry(spark, sf))


@query("stream_trip_humidity", TEL + TRIPS_SQL + f""" SELECT device_id, first_us, rh_baseline, rh_peak, {snap('rh_peak-rh_baseline')} AS rh_range, true AS closed FROM
  (SELECT device_id, min(us) AS first_us, min(reading) FILTER (sensor='humidity') AS rh_baseline, max(reading) FILTER (sensor='humidity') AS rh_peak
   FROM n GROUP BY device_id, trip) WHERE rh_baseline IS NOT NULL""")
def stream_trip_humidity(spark, sf):
    return trips.trip_humidity(telemetry(spark, sf))


@query("stream_prevalence_drift", TEL + f""" SELECT window_start, n, n_positive, prevalence, abs(prevalence-cast(0.2 AS double))>cast(0.05 AS double) AS drift_alert FROM
  (SELECT us//86400000000*86400 AS window_start, count(*) AS n, cast(sum(CASE WHEN sensor='vibration' THEN 1 ELSE 0 END) AS bigint) AS n_positive,
   {snap("sum(CASE WHEN sensor='vibration' THEN 1 ELSE 0 END)/cast(count(*) AS double)")} AS prevalence FROM tel GROUP BY 1)""")
def stream_prevalence_drift(spark, sf):
    return ops.prevalence_drift(telemetry(spark, sf).withColumn("label", (F.col("sensor") == "vibration").cast("int")))


@query("window_anomaly")
def window_anomaly(spark, sf):
    """Which window of a device drove its anomaly: reconstruction error of windowed summaries."""
    columns = ["n_readings", "reading_mean", "reading_max", "reading_min", "reading_std"]
    rows = stage(ops.rollup(telemetry(spark, sf), "1 day", None, ["device_id"]).fillna(0.0, ["reading_std"]), "windows")
    rows = rows.withColumn("silent_failure", F.lit(0))
    found = stage(anomaly.reconstruction_error(rows, anomaly.fit_subspace(rows, columns, 2)), "errors")
    cut = anomaly.error_cut(found)
    return anomaly.flag(found, cut).select("device_id", "window_start", snapped("recon_error").alias("recon_error"), "is_anomaly")
