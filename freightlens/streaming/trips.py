"""Stream state that ends: gaps per window and summaries per trip, both cleared once the watermark has passed them.

State is kept by Spark's state store (RocksDB, see `session.DEFAULTS`), so neither the driver nor a worker holds it. Each
transform has a batch twin that gives the same rows for any order of arrival within the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from freightlens.functions.scalars import ratio, snap
from freightlens.operators import linear
from freightlens.operators.decide import risk_tier
from freightlens.streaming.telemetry import KEYS, LATE, TRANSIT_MODEL, longest_gaps

GAPS = "window_start bigint, gap_us bigint"
TRIPS = ("device_id bigint, first_us bigint, last_us bigint, n_readings bigint, total double, peak double, n_vibration bigint, "
         "rh_low double, rh_high double, closed boolean")


class WindowGaps(StatefulProcessor):
    """Distinct times of one (keys, window), by minute; a late time is put where it belongs and so splits its gap. The
    longest gap is sent once, when the watermark reaches the end of the window."""

    def __init__(self, width_us: int, names: list[str]):
        self.width_us, self.names = width_us, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.minutes = handle.getMapState("minutes", "minute bigint", "times array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        end_ms = (int(key[-1]) * 1_000_000 + self.width_us) // 1_000
        if end_ms > timerValues.getCurrentWatermarkInMs():  # else the window is closed and its row was sent
            for frame in rows:
                for minute, times in frame["t"].groupby(frame["t"] // 60_000_000):
                    held = self.minutes.getValue((int(minute),))[0] if self.minutes.containsKey((int(minute),)) else []
                    self.minutes.updateValue((int(minute),), (sorted({*map(int, held), *map(int, times)}),))
            self.handle.registerTimer(end_ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        times = sorted(int(t) for _, (held,) in self.minutes.iterator() for t in held)
        longest = max((b - a for a, b in zip(times, times[1:])), default=0)
        self.minutes.clear()
        yield pd.DataFrame([[*key, longest]], columns=[*self.names, "window_start", "gap_us"])

    def close(self) -> None:
        pass


def stream_window_gaps(df: DataFrame, width_seconds: int = 21_600, keys: list[str] = KEYS, delay: str = LATE) -> DataFrame:
    """(keys, window_start, max_gap_hours) of a stream, one row per closed window: what `longest_gaps` gives for a table."""
    if not df.isStreaming:
        return longest_gaps(df, width_seconds, keys)
    kinds = dict(df.dtypes)
    width_us = width_seconds * 1_000_000
    times = df.withWatermark("ts", delay).withColumn("t", F.unix_micros("ts")).withColumn(
        "window_start", F.expr(f"t div {width_us}L") * width_seconds)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + GAPS
    found = times.groupBy(*keys, "window_start").transformWithStateInPandas(
        WindowGaps(width_us, keys), schema, "append", "EventTime")
    return found.select(*keys, "window_start", snap(F.col("gap_us") / F.lit(3_600_000_000.0)).alias("max_gap_hours"))


class Trips(StatefulProcessor):
    """The open trip of one device as one small row. A reading after more than `gap_us` of silence, or a watermark as far
    past the last reading, ends the trip and forgets it."""

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.trip = handle.getValueState("trip", TRIPS.split(", ", 1)[1].rsplit(", ", 1)[0])

    def _row(self, key, trip, closed: bool) -> list:
        return [key[0], *trip, closed]

    def _frame(self, rows: list[list]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=[f.split()[0] for f in TRIPS.split(", ")])
        return frame.astype({"rh_low": float, "rh_high": float, "total": float, "peak": float})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("t", kind="stable")
        trip = list(self.trip.get()) if self.trip.exists() else None
        out = []
        ends = new["t"].diff() > self.gap_us
        for _, part in new.groupby(ends.cumsum()):  # runs without a long silence
            humid = part["reading"][part["sensor"] == "humidity"]
            found = [int(part["t"].min()), int(part["t"].max()), len(part), float(part["reading"].sum()), float(part["reading"].max()),
                     int((part["sensor"] == "vibration").sum()), _or_none(humid.min()), _or_none(humid.max())]
            if trip is not None and found[0] - trip[1] <= self.gap_us:
                trip = _merged(trip, found)
            else:
                if trip is not None:
                    out.append(self._row(key, trip, True))
                trip = found
        self.trip.update(tuple(trip))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((trip[1] + self.gap_us) // 1_000 + 1)
        out.append(self._row(key, trip, False))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        trip = self.trip.get()
        self.trip.clear()
        yield self._frame([self._row(key, trip, True)])

    def close(self) -> None:
        pass


def _or_none(value: float) -> float | None:
    return None if pd.isna(value) else float(value)


def _merged(a: list, b: list) -> list:
    """Summaries of two parts of one trip as one."""
    pick = lambda best, x, y: best((v for v in (x, y) if not pd.isna(v)), default=None)
    return [min(a[0], b[0]), max(a[1], b[1]), a[2] + b[2], a[3] + b[3], pick(max, a[4], b[4]), a[5] + b[5], pick(min, a[6], b[6]),
            pick(max, a[7], b[7])]


def trips(df: DataFrame, gap_seconds: int = 21_600, delay: str = LATE) -> DataFrame:
    """One summary per (device, trip); trips part at more than `gap_seconds` of silence.

    A table gives each trip once, closed. A stream sends the open trip of a device whenever readings arrive (closed =
    false) and once more when it ends; nothing is kept of it after that. The watermark's delay must not exceed the gap.
    """
    if df.isStreaming:
        rows = df.withWatermark("ts", delay).select("device_id", "ts", "sensor", F.col("reading").cast("double").alias("reading"),
                                                    F.unix_micros("ts").alias("t"))
        return rows.groupBy("device_id").transformWithStateInPandas(Trips(gap_seconds * 1_000_000), TRIPS, "append", "EventTime")
    humid = F.when(F.col("sensor") == "humidity", F.col("reading"))
    # a session window is half open: one more microsecond lets a silence of exactly the gap stay inside a trip
    window = F.session_window("ts", f"{gap_seconds} seconds 1 microseconds")
    return df.groupBy("device_id", window.alias("w")).agg(
        F.min(F.unix_micros("ts")).alias("first_us"), F.max(F.unix_micros("ts")).alias("last_us"), F.count("*").alias("n_readings"),
        F.sum("reading").alias("total"), F.max("reading").alias("peak"), F.count_if(F.col("sensor") == "vibration").alias("n_vibration"),
        F.min(humid).alias("rh_low"), F.max(humid).alias("rh_high")).drop("w").withColumn("closed", F.lit(True))


def rescore_trips(df: DataFrame, theta: float = 0.30, model: linear.LinearModel = TRANSIT_MODEL) -> DataFrame:
    """Risk of each trip so far, from `trips` of a table or a stream."""
    summary = trips(df).withColumns({"reading_mean": ratio(F.col("total"), F.col("n_readings")), "reading_max": F.col("peak")})
    return linear.score(summary, model).withColumn("risk_tier", risk_tier("p", theta)).select(
        "device_id", "first_us", "n_readings", "p", "risk_tier", "closed")


def trip_humidity(df: DataFrame) -> DataFrame:
    """Humidity baseline, peak and their distance per trip; trips without a humidity reading give no row."""
    return trips(df).where("rh_low IS NOT NULL").select(
        "device_id", "first_us", F.col("rh_low").alias("rh_baseline"), F.col("rh_high").alias("rh_peak"),
        snap(F.col("rh_high") - F.col("rh_low")).alias("rh_range"), "closed")
