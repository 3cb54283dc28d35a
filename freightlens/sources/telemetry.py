"""Sensor telemetry derived from the events table, as a batch or a streaming source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SENSORS = {"view": "temperature", "click": "humidity", "error": "vibration", "signup": "door", "purchase": "location"}


def _shape(events: DataFrame) -> DataFrame:
    kind = F.coalesce(*[F.when(F.col("event_type") == e, s) for e, s in SENSORS.items()], F.lit("other"))
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("device_id"),
                         kind.alias("sensor"), F.col("value").alias("reading"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shape(spark.read.parquet(f"{sf_dir}/events.parquet"))


def telemetry_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 100) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
        .option("maxFilesPerTrigger", files_per_trigger).parquet(sf_dir)
    )
    return _shape(rows)
