"""Streams against their batch replay, and what they keep."""

import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from dialogmill.plans.base import events
from dialogmill.streaming import joins, live, stateful
from dialogmill.streaming.merge import MergedTable
from dialogmill.streaming.run import available_now, settings

e = lambda i, ms, kind, text="hello there you", **k: {"event_id": i, "ms": ms, "kind": kind, "text": text, "self_rms": 120.0, "remote_rms": 640.0} | k
what = lambda fold, rows: [(r[1], r[2]) for r in fold.run({}, rows)]


def test_live_folds():
    hold = [e(0, 0, "diag"), e(1, 100, "remote"), e(2, 700, "self"), e(3, 2000, "self", "other words here"), e(4, 2900, "self", "more words now"), e(5, 3100, "remote", "more words now"), e(6, 9000, "diag")]
    assert what(live.EchoHold(), hold) == [("remote", 1), ("dropped", 2), ("self", 3), ("self", 4), ("remote", 5)]  # the level is too old for the last echo
    twice = [e(1, 0, "self", "first one now"), e(2, 100, "self", "second one now"), e(3, 5000, "diag")]
    assert what(live.EchoHold(), twice) == [("self", 1), ("self", 2)] and what(live.EchoHold(lossy=True), twice) == [("lost", 1), ("self", 2)]
    seg = [e(1, 0, "remote", "hello wor"), e(2, 300, "remote", "hello world"), e(3, 800, "remote", "ends."), e(4, 1200, "remote", "next"), e(5, 9000, "remote", "last")]
    assert [(r[2], r[3]) for r in live.Segments().run({}, seg)] == [(3, "hello world ends."), (4, "next")]
    q = [e(i, i, "remote", work=100) for i in range(5)] + [e(9, 1000, "remote", work=1)]
    assert what(live.Queue(), q) == [("served", 0), ("dropped", 1), ("dropped", 2), ("served", 3), ("served", 4), ("served", 9)]
    assert what(live.Phases(), [e(0, 0, "running"), e(1, 1, "degraded"), e(2, 2, "running"), e(3, 3, "error"), e(4, 4, "running")]) == [("degraded", 1), ("running", 2), ("error", 3)]
    level = [e(i, i * 1000, "", level=10.0, other=200.0) for i in range(15)]
    assert what(live.SourceHealth(), level) == [("switch", 4), ("suspect", 8), ("switch", 12), ("healthy", 13)]
    assert what(live.SourceHealth(rest_ms=2000), [*level[:4], *[x | {"ms": x["ms"] + 2000} for x in level[4:6]]]) == []  # a new session has heard nothing yet


def test_echoes_are_compared_without_punctuation():
    rows = [e(0, 0, "diag"), e(1, 100, "remote", "let us ship it today"), e(2, 700, "self", "Let us ship it, today."), e(3, 800, "self", "?! -"), e(4, 900, "self", "a.b"), e(5, 5000, "diag")]
    assert what(live.EchoHold(), rows) == [("remote", 1), ("dropped", 2), ("dropped", 3), ("self", 4)]
    assert live.similarity("It's 5 o'clock_now", "IT S 5 O CLOCK NOW") == 1.0 and live.similarity("", "a") == 0.0


def test_one_closer_may_follow_the_punctuation():
    due = lambda text: live.Segments().due({"open": {"text": text, "started": 0, "updated": 0}})
    assert [due(t) for t in ("done.", 'done."', "done.)", 'done.")', "done", "done.''")] == [320, 320, 320, 1200, 1200, 1200]


def test_utterance_buffers():
    fold = live.Utterances({"remote": 100.0, "self": 50.0}, silence_ms=540, min_n=2)
    rows = [e(1, 0, "remote", level=5.0), e(2, 10, "remote", level=200.0), e(3, 20, "self", level=60.0), e(4, 300, "remote", level=1.0), e(5, 2000, "self", level=1.0), e(6, 2001, "muted", level=900.0), e(7, 5000, "self", level=1.0)]
    # the small buffer of the own side waits for a second chunk and is then due at the next check
    assert fold.run({}, rows) == [(560, "remote", 2, "2 4", 1.0), (2000, "self", 3, "3 5", 0.0)]


def test_sessions_are_in_whole_milliseconds(spark, tmp_path):
    from compare import differences

    import duckdb

    from dialogmill.plans import registry

    at = lambda s, us=0: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s, microseconds=us)
    # the first user's pause is 2 hours in milliseconds and less in microseconds; the third's session ends at the watermark's very millisecond
    rows = [(1, at(0, 900), 1), (2, at(7200, 100), 1), (3, at(0, 100), 2), (4, at(7200, 900), 2), (5, at(92_200, 700), 3), (6, at(100_000, 300), 4)]
    spark.createDataFrame([(i, ts, u, "click", 1.0, "{}") for i, ts, u in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert differences(registry.QUERIES["stream_sessions"](spark, str(tmp_path)), registry.SQL["stream_sessions"], con) is None


def parts(spark, sf_dir, tmp_path, n=4, end=None):
    """The events in n files, one a batch, each in the order of time; ``end``: an event far later, at the last file's end."""
    rows = events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", "value", "props").toPandas().sort_values("ts")
    if end:
        rows.loc[len(rows)] = [10**9, rows.ts.max() + end, 10**6, "click", 1.0, "{}"]
    size = -(-len(rows) // n)
    for i in range(n):
        spark.createDataFrame(rows.iloc[i * size : (i + 1) * size], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"file://{tmp_path}/p{i}")
        for f in (tmp_path / f"p{i}").glob("*.parquet"):
            f.rename(tmp_path / f"events.parquet.{i}.parquet")
            import os

            os.utime(tmp_path / f"events.parquet.{i}.parquet", (1000 + i, 1000 + i))
    from dialogmill.streaming.events import SCHEMA

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/events.parquet.*.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


FOLDS = [live.Segments(), live.Queue(), live.Utterances({"remote": 100.0, "self": 50.0}, rest_ms=6000)]


@pytest.mark.parametrize("fold", FOLDS, ids=lambda f: type(f).__name__)
def test_a_stream_in_batches_equals_the_replay_and_its_state_goes(spark, sf_dir, tmp_path, fold):
    seen = []
    rows = parts(spark, sf_dir, tmp_path, end=datetime.timedelta(days=40))
    got = available_now(rows, lambda s: stateful.stream(live.session_events(s), fold, live.SCALE), "append", stateful.ROCKSDB, seen)
    plain = lambda df: sorted(tuple(None if x != x else x for x in r) for r in df.collect())
    want = [r for r in plain(live.replay(live.session_events(events(spark, sf_dir)), fold, flush=True))]
    assert [r for r in plain(got) if r[0] < 10**6] == want and len(want) > 50
    held = [p["stateOperators"][0]["numRowsTotal"] for p in seen if p["stateOperators"]]
    assert len(seen) >= 4 and max(held) > 10 and held[-1] <= 3  # the far event's own: it waits, with its clock
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")


def test_a_batch_of_a_key_is_one_row_of_its_state():
    from unittest.mock import MagicMock

    states = {}
    handle = MagicMock()
    handle.getListState.side_effect = handle.getValueState.side_effect = lambda name, schema: states.setdefault(name, MagicMock())
    p = stateful.FoldProcessor(live.EchoHold(), "ms bigint, event_id bigint, self_rms double")
    p.init(handle)
    states["clock"].get.return_value = None
    p.handleInputRows((1,), iter([Row(user_id=1, ts=None, ms=9 - i, event=f'{{"ms":{9 - i},"event_id":{i},"self_rms":"NaN"}}') for i in range(5)]), None)
    ((rows,), _) = states["waiting"].appendList.call_args
    assert len(rows) == 1 and rows[0][0] == [9, 8, 7, 6, 5] and len(rows[0][1]) == 5
    handle.registerTimer.assert_called_once_with(5)
    e = p.read(rows[0][1][0])
    assert (e["ms"], e["event_id"]) == (9, 0) and e["self_rms"] != e["self_rms"]


def test_a_stream_join_equals_the_batch_join_and_its_state_goes(spark, sf_dir, tmp_path):
    seen, hold = [], 12 * 3_600_000
    rows = parts(spark, sf_dir, tmp_path, end=datetime.timedelta(days=40))
    own, remote = rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1 OR event_id = 1000000000")
    out = available_now(own, lambda s: joins.held_against(s, remote, "12 HOURS"), "append", stateful.ROCKSDB, seen)
    by, own_ms = {}, {}
    for r in events(spark, sf_dir).select("user_id", "ms", "event_id").collect():
        by.setdefault(r["user_id"], []).append((r["ms"], r["event_id"]))
    want = set()
    for rows_ in by.values():
        for ms, i in rows_:
            if i % 2 == 0:
                own_ms[i] = ms
                met = {(i, j) for at, j in rows_ if j % 2 and ms <= at <= ms + hold}
                want |= met or {(i, None)}
    got = [(r["event_id"], r["right_id"]) for r in out.collect() if r["event_id"] != 10**9]
    assert len(got) == len(set(got)) and set(got) == want and any(j is None for _, j in want) and any(j is not None for _, j in want)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in seen if p["stateOperators"]]
    assert max(held) > 10 * max(1, held[-1])


def timed(spark, path, seconds):
    """One user's events, numbered, at these seconds after a cell's begin, as a stream; those of odd numbers are remote."""
    rows = spark.createDataFrame([(i, 1_700_006_400 * 10**6 + round(s * 10**6), 1) for i, s in enumerate(seconds)], "event_id long, us long, user_id long").select("event_id", F.timestamp_micros("us").alias("ts"), "user_id")
    rows.coalesce(1).write.parquet(f"file://{path}")
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{path}")
    return stream.where("event_id % 2 = 0"), stream.where("event_id % 2 = 1")


def test_a_row_of_a_stream_join_meets_its_cells_rows_only(spark, tmp_path):
    own, remote = timed(spark, tmp_path / "in", [1800 * i for i in range(400)])
    with settings(spark, joins.STATE | {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}):
        out = joins.held_against(own, remote, "30 MINUTES")
        out.writeStream.option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).format("parquet").start(f"file://{tmp_path}/out").awaitTermination()
    for side in ("left", "right"):
        state = spark.read.format("statestore").option("joinSide", side).load(f"file://{tmp_path}/state")
        n = [r["count"] for r in state.groupBy("key").count().collect()]
        assert sum(n) >= 200 and max(n) <= 4


@pytest.mark.parametrize("hold, hold_s", [("30 MINUTES", 1800), ("5 HOURS", 18000)])
def test_a_stream_join_over_cells_gives_each_pair_once(spark, tmp_path, hold, hold_s):
    edges = [-7200, -0.000001, 0, 1800, 7199.999999, 7200, 8999.999999, 9000, 14400, 25200, 25200.000001]
    seconds = [s for edge in edges for s in (edge, edge)] + [10**8] * 2  # each as an own and as a remote row
    own, remote = timed(spark, tmp_path / "in", seconds)
    got = [tuple(r) for r in available_now(own, lambda s: joins.held_against(s, remote, hold), "append", joins.STATE).select("event_id", "right_id").collect()]
    want = [(a, b) for a in range(0, len(seconds), 2) for b in range(1, len(seconds), 2) if 0 <= round((seconds[b] - seconds[a]) * 10**6) <= hold_s * 10**6]
    assert sorted(got) == want
    own, remote = timed(spark, tmp_path / "alone", [0, 9000.5, 7200, 10**6, 20000, 10**8, 10**8, 10**8])
    got = {tuple(r) for r in available_now(own, lambda s: joins.held_against(s, remote, "30 MINUTES"), "append", joins.STATE).select("event_id", "right_id").collect()}
    assert got == {(0, None), (2, None), (4, None), (6, 5), (6, 7)}


def test_merges_are_done_once_and_touch_changed_buckets_only(spark, tmp_path):
    import random

    schema, rng = "k long, at long, a string, b double", random.Random(3)
    table = MergedTable(spark, f"file://{tmp_path}/t", schema, ["k"], "at", ["a", "b"], buckets=8)
    assert table.rows().count() == 0 and table.versions() == {}
    want, frames = {}, []
    for i in range(3):
        rows = [(rng.randrange(4 * (i + 1)), 100 * i + j, rng.choice([None, f"x{j}"]), rng.choice([None, j + 0.5])) for j in range(12)]
        frames.append(spark.createDataFrame(rows, schema))
        for k, at, a, b in rows:
            old = want.get(k, (None, None, None))
            want[k] = (at, a if a is not None else old[1], b if b is not None else old[2])
        table.apply(frames[i], i)
        assert {r["k"]: (r["at"], r["a"], r["b"]) for r in table.rows().collect()} == want
    before, files = table.versions(), sorted(p for p in tmp_path.rglob("*.parquet"))
    table.apply(frames[1], 1)  # again, after a failure
    table.apply(frames[2], 2)
    assert table.versions() == before and sorted(tmp_path.rglob("*.parquet")) == files
    table.apply(spark.createDataFrame([(0, 1000, "new", None)], schema), 3)
    after = table.versions()
    assert sum(after[b] != before[b] for b in before) == 1
    assert {r["k"]: r["a"] for r in table.rows().collect()}[0] == "new" and {r["k"]: r["b"] for r in table.rows().collect()}[0] == want[0][2]


def test_settings_are_put_back(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    with settings(spark, {"spark.sql.shuffle.partitions": "9", "dialogmill.none": "x"}):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "9" and spark.conf.get("dialogmill.none") == "x"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4" and spark.conf.get("dialogmill.none", None) is None
