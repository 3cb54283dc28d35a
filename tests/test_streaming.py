"""Each stream, drained over the events table, against its batch twin."""

import pytest
from pyspark.sql import functions as F

from freightlens.session import new_folder, stage
from freightlens.sources.shipments import RAW_SCHEMA, raw_shipments
from freightlens.sources.telemetry import telemetry, telemetry_stream
from freightlens.operators.validate import annotate
from freightlens.streaming import telemetry as ops


def drain(spark, df, mode="append"):
    out, mark = new_folder(spark, "stream"), new_folder(spark, "mark")
    ops.run_to_table(df, out, mode=mode, checkpoint=mark).awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def closed(df, spark, sf, seconds, column="window_start"):
    """Windows that ended before the final watermark."""
    last = telemetry(spark, sf).agg(F.max(F.unix_seconds("ts"))).first()[0] - 3600
    return df.where(F.col(column) + seconds <= last)


def test_rollup(spark, sf):
    got = drain(spark, ops.rollup(telemetry_stream(spark, sf)))
    want = closed(ops.rollup(telemetry(spark, sf)), spark, sf, 21_600)
    assert want.count() > 0 and got.count() == want.count() and got.exceptAll(want).count() == 0


def test_sessions(spark, sf):
    got = drain(spark, ops.stream_sessions(telemetry_stream(spark, sf)))
    whole = ops.batch_sessions(telemetry(spark, sf))
    assert got.count() > 0 and got.exceptAll(whole.select(*got.columns)).count() == 0
    same = ops.stream_sessions(telemetry(spark, sf))
    assert same.select(*whole.columns).exceptAll(whole).count() == 0 and same.count() == whole.count()


def test_dedupe(spark, sf):
    rows = telemetry_stream(spark, sf).withColumn("_c", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_c")
    got = drain(spark, ops.dedupe(rows))
    assert got.count() == telemetry(spark, sf).count() == got.select("event_id").distinct().count()


def test_drift(spark, sf):
    label = lambda df: df.withColumn("label", (F.col("sensor") == "vibration").cast("int"))
    got = drain(spark, ops.prevalence_drift(label(telemetry_stream(spark, sf))))
    want = closed(ops.prevalence_drift(label(telemetry(spark, sf))), spark, sf, 86_400)
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


@pytest.mark.parametrize("transform", [ops.rescore, ops.humidity_range])
def test_running_summaries(spark, sf, transform):
    name = f"live_{transform.__name__}"
    q = transform(telemetry_stream(spark, sf)).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = transform(telemetry(spark, sf))
    assert spark.table(name).select(*want.columns).exceptAll(want).count() == 0


def test_gap_state(spark, sf):
    q = ops.stream_gaps(telemetry_stream(spark, sf)).writeStream.format("memory").queryName("live_gaps").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r[0], r[1]): r[2] for r in spark.table("live_gaps").groupBy("device_id", "sensor").agg(F.max("gap_hours")).collect()}
    want = {(r[0], r[1]): r[2] for r in ops.longest_gaps(telemetry(spark, sf), 86_400 * 400).groupBy("device_id", "sensor").agg(F.max("max_gap_hours")).collect()}
    assert set(got) == set(want)
    assert all(abs((got[k] or 0.0) - want[k]) < 1e-5 for k in want)


def test_quarantine_sinks(spark, sf):
    landed = new_folder(spark, "landed")
    raw_shipments(spark, sf).write.parquet(landed)
    good, bad, mark = (new_folder(spark, n) for n in ("good", "bad", "mark"))
    ops.quarantine_stream(spark.readStream.schema(RAW_SCHEMA).parquet(landed), good, bad, mark).awaitTermination()
    whole = stage(annotate(spark.read.schema(RAW_SCHEMA).parquet(landed)))
    assert spark.read.parquet(good).count() == whole.where("size(_errors) = 0").count() > 0
    assert spark.read.parquet(bad).count() == whole.where("size(_errors) > 0").count() > 0
