"""Scans over blocks against plain loops; a part of any size is cut."""

import random

import pytest
from pyspark.sql import functions as F

from dialogmill.operators import percentiles, scan, turns


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = [(u, t, t, rng.choice([None, 1, 2, 5, 9]), "ab"[t % 2]) for u, n in ((0, 150), (1, 5), (None, 7)) for t in range(n)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "user_id long, ms long, event_id long, value long, side string")


def by_user(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: r["ms"]):
        out.setdefault(r["user_id"], []).append(r)
    return out


@pytest.mark.parametrize("per", [7, 1000])
def test_sums_and_last_values(rows, per):
    blocks = scan.dealt(rows, ["user_id"], ["ms"], per)
    if per == 7:
        assert blocks.where("user_id = 0").select(scan.BLOCK).distinct().count() >= 12  # one user is the work of many tasks
    out = scan.sums_before(blocks, ["user_id"], ["ms"], {"before": F.col("value"), "n": F.lit(1)})
    out = scan.sums_before(out, ["user_id"], ["ms"], {"upto": F.col("value")}, running=True)
    out = scan.last_before(out, ["user_id"], ["ms"], {"last": F.col("value"), "last_a": F.when(F.col("side") == "a", F.col("ms"))})
    out = scan.last_before(out, ["user_id"], ["ms"], {"now": F.col("value")}, running=True)
    whole = scan.sums_before(blocks, [], ["ms", "user_id"], {"all": F.lit(1)})
    for user in by_user(out).values():
        total, last, last_a = 0, None, None
        for i, r in enumerate(user):
            assert (r["before"], r["n"], r["last"], r["last_a"]) == (total, i, last, last_a)
            total += r["value"] or 0
            last = r["value"] if r["value"] is not None else last
            last_a = r["ms"] if r["side"] == "a" else last_a
            assert (r["upto"], r["now"]) == (total, last)
    assert whole.count() == 162
    assert scan.sums_before(scan.dealt(rows.limit(0), ["user_id"], ["ms"]), ["user_id"], ["ms"], {"n": F.lit(1)}).count() == 0


def test_spans_of_blocks_add_up(rows, monkeypatch):
    monkeypatch.setattr(scan, "SPAN", 3)
    blocks = scan.dealt(rows, ["user_id"], ["ms"], 5)
    out = scan.last_before(scan.sums_before(blocks, ["user_id"], ["ms"], {"n": F.lit(1)}), ["user_id"], ["ms"], {"at": F.col("ms")})
    assert all((r["n"], r["at"]) == (i, i - 1 if i else None) for user in by_user(out).values() for i, r in enumerate(user))


@pytest.mark.parametrize("per", [8, 1000])
def test_rolling_quantiles(rows, per):
    got = {}
    some = rows.where("user_id IS NOT NULL")
    one = some.withColumn("event_id", F.col("user_id") * 1000 + F.col("event_id"))
    for r in percentiles.rolling(one, "user_id", "event_id", "value", {"p50": 0.5, "p95": 0.95}, 6, per).collect():
        got[r["event_id"]] = (r["n"], r["p50"], r["p95"])
    for user, events in by_user(some).items():
        for i, r in enumerate(events):
            frame = sorted(x["value"] for x in events[max(0, i - 5) : i + 1] if x["value"] is not None)
            place = lambda p: frame[max(0, -(-int(len(frame) * p * 100) // 100) - 1)] if frame else None  # noqa: B023, E731
            assert got[user * 1000 + r["event_id"]] == (len(frame), place(0.5), place(0.95))


def test_time_pieces_hold_their_frames(rows):
    pieces = scan.in_time_pieces(rows, ["user_id"], "ms", 5, factor=2)
    owners = {(r["user_id"], r["ms"]): r["__piece"] for r in pieces.where("NOT __halo").collect()}
    there = {(r["user_id"], r["ms"], r["__piece"]) for r in pieces.collect()}
    assert len(owners) == 162
    for (user, ms), piece in owners.items():
        assert all((user, t, piece) in there for t in range(max(0, ms - 5), ms))


@pytest.mark.parametrize("per", [6, 1000])
def test_sessions_and_as_of_rows_of_one_long_user(rows, per):
    gaps = rows.withColumn("ms", F.col("ms") + F.floor(F.col("ms") / 10) * 100)
    for user in by_user(turns.gap_sessions(gaps, ["user_id"], "ms", 50, per)).values():
        assert [r["session"] for r in user] == [i // 10 + 1 for i in range(len(user))]
    got = turns.as_of(rows, ["user_id"], "ms", {"a": (F.col("side") == "a", ["ms", "value"]), "b": (F.col("side") == "b", ["ms"])}, per)
    for user in by_user(got).values():
        for i, r in enumerate(user):
            assert (r["a"] and r["a"]["ms"]) == (None if i == 0 else (i - 1) // 2 * 2) and (r["b"] and r["b"]["ms"]) == (None if i < 2 else (i - 2) // 2 * 2 + 1)
