"""Telemetry operators. The same transform serves batch and stream unless a stream needs its own state."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from freightlens.functions.scalars import ratio, snap
from freightlens.operators import linear
from freightlens.operators.decide import risk_tier
from freightlens.operators.validate import annotate, quarantined_rows, valid_rows

LATE = "1 hour"
KEYS = ["device_id", "sensor"]


def watermarked(df: DataFrame, delay: str = LATE) -> DataFrame:
    return df.withWatermark("ts", delay) if df.isStreaming else df


# --- summaries ----------------------------------------------------------------------------------------

def rollup(df: DataFrame, width: str = "6 hours", slide: str | None = None, keys: list[str] = KEYS) -> DataFrame:
    """Count, mean, max, min and deviation of the readings per tumbling or sliding window."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = watermarked(df).groupBy(*keys, window.alias("w")).agg(
        F.count("*").alias("n_readings"), F.avg("reading").alias("reading_mean"), F.max("reading").alias("reading_max"),
        F.min("reading").alias("reading_min"), F.stddev_samp("reading").alias("reading_std"),
    )
    return out.select(*keys, F.unix_seconds("w.start").alias("window_start"), "n_readings", *[
        snap(c).alias(c) for c in ("reading_mean", "reading_max", "reading_min", "reading_std")
    ])


def longest_gaps(df: DataFrame, width_seconds: int = 21_600, keys: list[str] = KEYS) -> DataFrame:
    """Longest silence in hours between readings of one window, for batch tables.

    Readings are first reduced to distinct times; gaps inside a minute and gaps between minutes
    are taken separately, so a device with very many readings is spread over its minutes.
    """
    micros = F.unix_micros("ts")
    moments = df.select(*keys, micros.alias("t")).distinct().withColumns({
        "window_start": F.expr(f"t div {width_seconds * 1_000_000}L") * width_seconds, "minute": F.expr("t div 60000000L"),
    })
    inside = Window.partitionBy(*keys, "window_start", "minute").orderBy("t")
    minutes = moments.withColumn("gap", F.col("t") - F.lag("t").over(inside)).groupBy(*keys, "window_start", "minute").agg(
        F.min("t").alias("first"), F.max("t").alias("last"), F.max("gap").alias("gap"))
    across = Window.partitionBy(*keys, "window_start").orderBy("minute")
    gaps = minutes.withColumn("between", F.col("first") - F.lag("last").over(across))
    longest = F.coalesce(F.greatest(F.max("gap"), F.max("between")), F.lit(0))
    return gaps.groupBy(*keys, "window_start").agg(snap(longest / F.lit(3_600_000_000.0)).alias("max_gap_hours"))


def rollup_with_gaps(df: DataFrame, width: str = "6 hours", width_seconds: int = 21_600, keys: list[str] = KEYS) -> DataFrame:
    return rollup(df, width, None, keys).join(longest_gaps(df, width_seconds, keys), [*keys, "window_start"])


def stream_gaps(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, ts, gap_hours) for a stream; the state is one timestamp per key, kept so that no silence is lost."""
    fields = {"device_id": "bigint", "sensor": "string"}
    head = ", ".join(f"{k} {fields[k]}" for k in keys)

    def step(key, frames, state):
        times = pd.concat([f["ts"] for f in frames]).sort_values(ignore_index=True)
        last = pd.Timestamp(state.get[0]) if state.exists else None
        before = times.shift(1)
        if last is not None:
            before.iloc[0] = last
        newest = times.iloc[-1] if last is None else max(times.iloc[-1], last)
        state.update((newest,))
        gap = (times - before).dt.total_seconds() / 3600.0
        yield pd.DataFrame({**{k: key[i] for i, k in enumerate(keys)}, "ts": times, "gap_hours": gap.clip(lower=0)})

    return df.groupBy(*keys).applyInPandasWithState(
        step, f"{head}, ts timestamp, gap_hours double", "last timestamp", "append", "NoTimeout")


def humidity_range(df: DataFrame) -> DataFrame:
    """Series minimum as baseline, and the distance of the maximum from it, per device."""
    return watermarked(df).where("sensor = 'humidity'").groupBy("device_id").agg(
        F.min("reading").alias("rh_baseline"), F.max("reading").alias("rh_peak"), F.count("*").alias("n_readings")
    ).withColumn("rh_range", snap(F.col("rh_peak") - F.col("rh_baseline")))


# --- sessions -----------------------------------------------------------------------------------------

def stream_sessions(df: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Trips split at long silence, with Spark's own session windows."""
    return watermarked(df).groupBy("device_id", F.session_window("ts", gap).alias("s")).agg(
        F.count("*").alias("n_readings"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    ).select("device_id", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "n_readings")


def batch_sessions(df: DataFrame, gap_seconds: int = 21_600, slot_seconds: int = 3_600) -> DataFrame:
    """The same sessions over a table.

    Two readings in one slot no longer than the gap always share a session, so readings are
    combined per (device, slot) before any ordering; the window then sees at most one row per
    slot of the calendar however many readings a device has.
    """
    if slot_seconds > gap_seconds:
        raise ValueError("a slot must not be longer than the session gap")
    t = F.unix_micros("ts")
    slots = df.groupBy("device_id", F.expr(f"unix_micros(ts) div {slot_seconds * 1_000_000}L").alias("slot")).agg(
        F.min(t).alias("first_us"), F.max(t).alias("last_us"), F.count("*").alias("n_readings"))
    order = Window.partitionBy("device_id").orderBy("slot")
    fresh = F.coalesce((F.col("first_us") - F.lag("last_us").over(order) > gap_seconds * 1_000_000).cast("int"), F.lit(1))
    numbered = slots.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(order))
    return numbered.groupBy("device_id", "session").agg(
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("n_readings").alias("n_readings")
    ).drop("session")


# --- hygiene, re-scoring, drift -------------------------------------------------------------------------

def dedupe(df: DataFrame) -> DataFrame:
    """One row per event id; a stream forgets ids once they are older than the watermark."""
    if df.isStreaming:
        return watermarked(df).dropDuplicatesWithinWatermark(["event_id"])
    return df.dropDuplicates(["event_id"])


# Parameters of the demonstration in-transit model.
TRANSIT_MODEL = linear.LinearModel(-3.0, {"reading_mean": 0.02, "reading_max": 0.004, "n_vibration": 0.02}, "transit-1")


def rescore(df: DataFrame, theta: float = 0.30, model: linear.LinearModel = TRANSIT_MODEL) -> DataFrame:
    """Running summary per device, scored and tiered; a stream in update mode emits each device again when it changes."""
    summary = watermarked(df).groupBy("device_id").agg(
        F.count("*").alias("n_readings"), F.avg("reading").alias("reading_mean"), F.max("reading").alias("reading_max"),
        F.count_if(F.col("sensor") == "vibration").alias("n_vibration"))
    return linear.score(summary, model).withColumn("risk_tier", risk_tier("p", theta)).select("device_id", "n_readings", "p", "risk_tier")


def prevalence_drift(df: DataFrame, expected: float = 0.20, tolerance: float = 0.05, width: str = "1 day") -> DataFrame:
    """Share of positive outcomes per window and whether it left the expected band; `label` is 0 or 1."""
    out = watermarked(df).groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.sum("label").alias("n_positive"))
    share = ratio(F.col("n_positive"), F.col("n"))
    return out.select(
        F.unix_seconds("w.start").alias("window_start"), "n", "n_positive", snap(share).alias("prevalence"),
        (F.abs(snap(share) - expected) > tolerance).alias("drift_alert"))


def quarantine_stream(raw: DataFrame, valid_path: str, rejected_path: str, checkpoint: str):
    """Validate a stream of text rows into two sinks.

    Each batch replaces its own folder, so a batch that is replayed after a failure leaves no
    duplicates.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = annotate(batch).persist()  # both sinks read one evaluation; a lost block is computed again
        valid_rows(rows).write.mode("overwrite").parquet(f"{valid_path}/batch={batch_id}")
        quarantined_rows(rows).write.mode("overwrite").parquet(f"{rejected_path}/batch={batch_id}")
        rows.unpersist()

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Drain what is available into a parquet table."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


