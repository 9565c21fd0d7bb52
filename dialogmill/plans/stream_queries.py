"""Streaming operators over events: each runs to the end of what there is, and equals its batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dialogmill.operators.state import shared_folder
from dialogmill.plans.base import query
from dialogmill.streaming import events as ev
from dialogmill.streaming import joins, merge
from dialogmill.streaming.run import available_now

C = F.col


@query("WITH w AS (SELECT user_id, event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL) SELECT * FROM w WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def stream_tumbling(spark, sf_dir):
    """Daily counts by a tumbling window in append mode: a day comes out, and its state goes, when the watermark has passed it."""
    out = available_now(ev.read(spark, sf_dir), lambda s: ev.tumbling(s), "append")
    return out.select("user_id", "event_type", C("day").cast("timestamp_ntz").alias("day"), "n", F.round("total", 4).alias("total"))


@query("""
WITH e AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events), l AS (SELECT *, CASE WHEN ms - lag(ms) OVER w < 7200000 THEN 0 ELSE 1 END AS opens FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS session FROM l), g AS (SELECT user_id, session, min(ms)::BIGINT AS first_ms, max(ms)::BIGINT AS last_ms, count(*)::BIGINT AS n FROM s GROUP BY 1, 2)
SELECT user_id, first_ms, last_ms, n FROM g WHERE last_ms + 7200000 <= (SELECT max(ms) FROM e) - 600000
""")
def stream_sessions(spark, sf_dir):
    """Two-hour gap sessions that the watermark, ten minutes behind, has closed."""
    return available_now(ev.read(spark, sf_dir), lambda s: ev.sessions(s), "append")


@query("SELECT user_id, max(event_id)::BIGINT AS event_id, arg_max(value, event_id) AS value, arg_max(event_type, event_id) FILTER (event_type <> 'click') AS event_type FROM events GROUP BY 1")
def stream_upsert(spark, sf_dir):
    """The last value and the last event that isn't a click of each user, merged batch by batch."""
    rows = ev.read(spark, sf_dir).select("user_id", "event_id", "value", F.when(C("event_type") != "click", C("event_type")).alias("event_type"))
    base = f"{shared_folder(spark)}/merged-{uuid.uuid4().hex}"
    table = merge.MergedTable(spark, f"{base}/table", "user_id long, event_id long, value double, event_type string", ["user_id"], "event_id", ["value", "event_type"])
    return merge.merge(rows, table, f"{base}/state")


@query("SELECT event_id, user_id FROM events")
def stream_dedup(spark, sf_dir):
    """Each event once, though the source gives each twice."""
    return available_now(ev.read(spark, sf_dir), lambda s: ev.dedup(s.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))), "append").select("event_id", "user_id")


@query("""
WITH e AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events), own AS (SELECT * FROM e WHERE event_id % 2 = 0), remote AS (SELECT * FROM e WHERE event_id % 2 = 1),
w AS (SELECT least((SELECT max(ms) - 600000 FROM own), (SELECT max(ms) - 1200000 FROM remote)) AS w)
SELECT a.event_id, b.event_id AS right_id FROM own a JOIN remote b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 30 MINUTE
UNION ALL SELECT event_id, NULL FROM own a, w WHERE ms + 1800000 < w AND NOT EXISTS (FROM remote b WHERE a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 30 MINUTE)
""")
def stream_hold(spark, sf_dir):
    """Own utterances against remote ones within the hold, as two streams with their own watermarks; those that none meets come out alone."""
    own, remote = ev.read(spark, sf_dir).where("event_id % 2 = 0"), ev.read(spark, sf_dir).where("event_id % 2 = 1")
    out = available_now(own, lambda s: joins.held_against(s, remote, "30 MINUTES", "10 minutes", "20 minutes"), "append", joins.STATE)
    return out.select("event_id", "right_id")
