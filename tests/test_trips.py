"""Streams whose state ends, drained in several batches of shuffled files, against their batch twins."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from freightlens.session import new_folder
from freightlens.streaming import trips

SCHEMA = "event_id bigint, ts timestamp, device_id bigint, sensor string, reading double"
ZERO = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="module")
def readings():
    """Two devices of several trips; a third of all times is repeated, one trip has no humidity; a last reading long after
    closes all that is before it."""
    draw, rows = random.Random(5), []
    for device in (1, 2):
        at = 0.0
        for trip in range(3):
            for _ in range(25):
                at += draw.choice([0.0, 20.0, 70.0, 1_800.0, 9_000.0])
                sensor = "temperature" if trip == 1 else draw.choice(["humidity", "vibration", "temperature"])
                rows.append((len(rows), ZERO + dt.timedelta(seconds=at), device, sensor, draw.uniform(0, 60)))
            at += 21_600 * 2
    rows.append((len(rows), ZERO + dt.timedelta(days=60), 3, "door", 1.0))
    return rows


def fed(spark, rows, label):
    """The rows as a stream of small files: neighbours in time are shuffled by up to half an hour, within the watermark."""
    draw, folder = random.Random(9), new_folder(spark, label)
    order = sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=draw.uniform(0, 1_800)))
    for first in range(0, len(order), 40):
        spark.createDataFrame(order[first : first + 40], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(stream, spark, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option(
        "checkpointLocation", new_folder(spark, "mark")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name), query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_gaps_of_windows(spark, readings):
    got, _ = drain(trips.stream_window_gaps(fed(spark, readings, "gaps")), spark, "gaps_live")
    want = trips.stream_window_gaps(spark.createDataFrame(readings[:-1], SCHEMA))
    assert got.count() == want.count() > 10 and got.exceptAll(want.select(*got.columns)).count() == 0
    assert want.where("max_gap_hours > 0").count() > 5


def test_trips_end_and_are_forgotten(spark, readings):
    live, state = drain(trips.rescore_trips(fed(spark, readings, "trips")), spark, "trips_live")
    want = trips.rescore_trips(spark.createDataFrame(readings[:-1], SCHEMA))
    rounded = lambda df: df.select("device_id", "first_us", "n_readings", F.round("p", 6).alias("p"), "risk_tier")
    closed = rounded(live.where("closed"))
    assert closed.count() == want.count() == 6 and closed.exceptAll(rounded(want)).count() == 0
    assert live.where("NOT closed").count() >= 6
    assert state <= 4  # one open trip and its timer: six trips have left nothing


def test_trip_humidity(spark, readings):
    live, _ = drain(trips.trip_humidity(fed(spark, readings, "humid")), spark, "humid_live")
    want = trips.trip_humidity(spark.createDataFrame(readings, SCHEMA))
    closed = live.where("closed")
    assert closed.count() == want.count() == 4 and closed.exceptAll(want).count() == 0
