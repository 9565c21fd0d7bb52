"""Joins of two streams in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogmill.streaming.stateful import ROCKSDB

#: Seconds of event time in a cell of the key: a few holds, so that few rows stand in two cells and few meet in one.
CELL = 7200

#: What a query with this join needs, given to run.available_now(): one store for both sides of a partition, where there were four, and rows are
#: put without a look whether they are new, so the progress doesn't give the state's rows.
STATE = ROCKSDB | {
    "spark.sql.streaming.join.stateFormatVersion": "3",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def held_against(own: DataFrame, remote: DataFrame, hold: str, own_late: str = "10 minutes", remote_late: str = "10 minutes", cell: int = CELL) -> DataFrame:
    """Each own row (user_id, ts, event_id) with every remote row of the user that comes within ``hold`` after it, and once with nulls if none does.

    Each side has its own watermark. A pair comes out when its later row arrives; a row without a partner when the watermark has passed its hold. Both sides'
    rows leave the state when no partner can come any more, so the state holds what the lateness and the hold span, not the streams.

    The join looks through all rows of a key for each row, so the key is a user's cell of ``cell`` seconds: an own row stands in its cell, a remote one in
    those from the earliest own row's to its own, so a pair shares exactly one. ``hold`` is less than a day, as days differ in length where clocks change.
    """
    a = own.select(F.col("user_id").alias("own_user"), F.col("ts").alias("own_ts"), F.col("event_id")).withWatermark("own_ts", own_late)
    b = remote.select(F.col("user_id").alias("remote_user"), F.col("ts").alias("remote_ts"), F.col("event_id").alias("right_id")).withWatermark("remote_ts", remote_late)
    a = a.withColumn("own_cell", F.expr(f"unix_seconds(own_ts) div {cell}"))
    b = b.withColumn("remote_cell", F.explode(F.expr(f"sequence(unix_seconds(remote_ts - INTERVAL {hold}) div {cell}, unix_seconds(remote_ts) div {cell})")))
    on = F.expr(f"own_user = remote_user AND own_cell = remote_cell AND remote_ts >= own_ts AND remote_ts <= own_ts + INTERVAL {hold}")
    return a.join(b, on, "left_outer").select("event_id", F.col("own_user").alias("user_id"), "own_ts", "right_id", "remote_ts")
