"""Streaming operators over timed events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
LATE = "10 minutes"


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's files as a stream; ts is a timestamp, as watermarks need."""
    rows = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, width: str = "1 day") -> DataFrame:
    rows = stream.withWatermark("ts", LATE).groupBy("user_id", "event_type", F.window("ts", width).alias("w"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("user_id", "event_type", F.col("w.start").alias("day"), "n", "total")


def sessions(stream: DataFrame, gap_ms: int = 7_200_000) -> DataFrame:
    """Sessions in whole milliseconds: a pause of ``gap_ms`` or more opens the next one.

    Session windows that touch are one, so theirs are a microsecond shorter; both ends of a pause and the watermark are whole milliseconds.
    """
    rows = stream.withColumn("ts", F.timestamp_millis(F.unix_millis("ts"))).withWatermark("ts", LATE).groupBy("user_id", F.session_window("ts", f"{gap_ms * 1000 - 1} microseconds").alias("w"))
    return rows.agg(F.min(F.unix_millis("ts")).alias("first_ms"), F.max(F.unix_millis("ts")).alias("last_ms"), F.count(F.lit(1)).alias("n")).select("user_id", "first_ms", "last_ms", "n")


def dedup(stream: DataFrame) -> DataFrame:
    return stream.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"])
