"""Live-session operators: folds over one key's events, as streams and as batch replays.

A fold is a plain function (state, event) -> rows with a deadline: timers fire in event time, when a later event
of the key or the clock passes the deadline. A fold declares its state as typed variables, which a stream keeps one by one (see
stateful.py) and a replay as a dict. A stream and the replay of the same events up to the watermark give the same rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogmill.streaming.run import send_package

LATE = "10 minutes"
OUT = "user_id long, ms long, what string, event_id long, text string, score double"
COLUMNS = ["user_id", "ms", "what", "event_id", "text", "score"]
EVENT = "ms long, event_id long, text string"
#: How many milliseconds of the events table make one of a live session.
SCALE = 20_000


class Live:
    """A fold: on(state, event) -> rows; due(state) -> deadline in ms or None; fire(state) -> rows. Rows are (ms, what, event_id, text) and, where there is one, a score.

    ``states``: the variables of the state, name -> (kind, schema): a value is a dict or absent, a list holds dicts, a map has strings as keys and dicts as values.
    ``rest_ms``: after a pause longer than this the state starts anew: nothing of it matters any more, or the session has ended. None: it may matter for ever.
    """

    states: dict[str, tuple[str, str]] = {}
    rest_ms: int | None = None

    def on(self, s: dict, e: dict) -> list[tuple]:
        raise NotImplementedError

    def due(self, s: dict) -> int | None:
        return None

    def fire(self, s: dict) -> list[tuple]:
        return []

    def over(self, s: dict, last: int) -> int | None:
        """From when on the state, after an event at ``last``, doesn't matter; None: for ever."""
        return None if self.rest_ms is None else last + self.rest_ms + 1

    def run(self, s: dict, events: list[dict], last: int | None = None) -> list[tuple]:
        """Rows of the events in order; ``last``: the time of the event before them."""
        out = []
        for e in events:
            out += self.until(s, e["ms"])
            if last is not None and self.rest_ms is not None and e["ms"] - last > self.rest_ms:
                s.clear()
            out += self.on(s, e)
            last = e["ms"]
        return out

    def until(self, s: dict, ms: int) -> list[tuple]:
        out = []
        while (at := self.due(s)) is not None and at <= ms:
            out += self.fire(s)
        return out


def speech(text: str) -> str:
    """Lower-cased letters and digits, other characters as single blanks."""
    return " ".join(re.sub(r"[^\w\s]|_", " ", text.lower()).split())


def similarity(a: str, b: str) -> float:
    x, y = set(speech(a).split()), set(speech(b).split())
    return len(x & y) / len(x | y) if x and y else 0.0


class Utterances(Live):
    """Voice-activity buffers of each speaker: a voiced chunk opens or extends a buffer, an unvoiced one extends an open one and counts as dropped otherwise.

    A buffer of ``min_n`` chunks or more becomes an utterance at the first check after ``silence_ms`` without voice; a smaller one waits for more chunks.
    Rows: the check's time, the speaker, the first chunk's id, the chunks in order, and the chunks dropped since the utterance before.
    """

    states = {"buffers": ("map", "n long, first long, voice long, updated long, dropped long, audio string")}

    def __init__(self, thresholds: dict[str, float], silence_ms: int = 540, min_n: int = 2, check_ms: int = 80, rest_ms: int = 1_800_000):
        self.thresholds, self.silence_ms, self.min_n, self.check_ms, self.rest_ms = thresholds, silence_ms, min_n, check_ms, rest_ms

    def at(self, b: dict) -> int | None:
        return -(-max(b["voice"] + self.silence_ms, b["updated"]) // self.check_ms) * self.check_ms if b["n"] >= self.min_n else None

    def next(self, s: dict) -> tuple[int, str] | None:
        return min(((at, k) for k, b in s.get("buffers", {}).items() if (at := self.at(b)) is not None), default=None)

    def due(self, s):
        found = self.next(s)
        return found and found[0]

    def fire(self, s):
        at, speaker = self.next(s)
        b = s["buffers"].pop(speaker)
        return [(at, speaker, b["first"], b["audio"], float(b["dropped"]))]

    def on(self, s, e):
        if e["kind"] not in self.thresholds:
            return []
        held = s.setdefault("buffers", {})
        b = held.setdefault(e["kind"], {"n": 0, "first": 0, "voice": 0, "updated": 0, "dropped": 0, "audio": ""})
        voiced = e["level"] >= self.thresholds[e["kind"]]
        if voiced or b["n"]:
            audio = str(e["event_id"]) if not b["n"] else f"{b['audio']} {e['event_id']}"
            b.update(n=b["n"] + 1, first=b["first"] if b["n"] else e["event_id"], voice=e["ms"] if voiced else b["voice"], updated=e["ms"], audio=audio)
        else:
            b["dropped"] += 1
        return []


class EchoHold(Live):
    """Own utterances wait for ``hold_ms``: an echo of the remote side, before or after, is dropped, else they commit.

    A newer utterance takes the place of a waiting one, which is lost (``lossy``) or commits first.
    """

    states = {"held": ("value", EVENT), "remote": ("value", EVENT), "diag": ("value", "ms long, self_rms double, remote_rms double")}

    def __init__(self, hold_ms: int = 650, window_ms: int = 1400, least: float = 0.9, lossy: bool = False):
        self.hold_ms, self.window_ms, self.least, self.lossy = hold_ms, window_ms, least, lossy
        self.rest_ms = max(hold_ms, window_ms, 2000)

    def echo(self, own: dict, s: dict) -> bool:
        remote, diag = s.get("remote"), s.get("diag")
        if len(speech(own["text"])) < 3:
            return True
        if not remote or not diag or abs(own["ms"] - remote["ms"]) > self.window_ms or similarity(own["text"], remote["text"]) < self.least:
            return False
        return abs(diag["ms"] - own["ms"]) <= 2000 and max(0.0, diag["self_rms"]) <= max(160.0, max(0.0, diag["remote_rms"]) * 0.45)

    def due(self, s):
        return s["held"]["ms"] + self.hold_ms if s.get("held") else None

    def fire(self, s):
        held = s.pop("held")
        return [(held["ms"], "self", held["event_id"], held["text"])]

    def on(self, s, e):
        kept = {k: e[k] for k in ("ms", "event_id", "text")}
        if e["kind"] == "diag":
            s["diag"] = {k: e[k] for k in ("ms", "self_rms", "remote_rms")}
            return []
        if e["kind"] == "self":
            if self.echo(e, s):
                return [(e["ms"], "dropped", e["event_id"], e["text"])]
            out = []
            if s.get("held"):
                out = [(s["held"]["ms"], "lost", s["held"]["event_id"], s["held"]["text"])] if self.lossy else self.fire(s)
            s["held"] = kept
            return out
        if e["kind"] != "remote":
            return []
        s["remote"], out = kept, []
        if s.get("held"):
            if self.echo(s["held"], s):
                held = s.pop("held")
                out = [(held["ms"], "dropped", held["event_id"], held["text"])]
            elif s["held"]["ms"] <= e["ms"]:
                out = self.fire(s)
        return [*out, (e["ms"], "remote", e["event_id"], e["text"])]


class Segments(Live):
    """Remote events merge into segments: closed after a pause, sooner after terminal punctuation, at a gap, or when held too long.

    A segment's confidence, its score, is the mean of what it had and the event's, one event after another.
    """

    states = {"open": ("value", "text string, started long, updated long, event_id long, confidence double")}

    def __init__(self, punctuation_ms: int = 320, pause_ms: int = 1200, hold_ms: int = 4200, gap_ms: int = 2200):
        self.punctuation_ms, self.pause_ms, self.hold_ms, self.gap_ms = punctuation_ms, pause_ms, hold_ms, gap_ms
        self.rest_ms = max(pause_ms, gap_ms, 120)

    def due(self, s):
        x = s.get("open")
        if not x:
            return None
        left = self.hold_ms - (x["updated"] - x["started"])
        if left <= 0:
            return x["updated"]
        ends = re.search(r"""[.!?]["')\]]?\Z""", x["text"])
        return x["updated"] + max(120, min(self.punctuation_ms if ends else self.pause_ms, left))

    def fire(self, s):
        x = s.pop("open")
        return [(x["updated"], "segment", x["event_id"], x["text"], x["confidence"])]

    def on(self, s, e):
        text = e["text"].strip()
        if e["kind"] != "remote" or not text:
            return []
        out = self.fire(s) if s.get("open") and e["ms"] - s["open"]["updated"] > self.gap_ms else []
        confidence = e.get("confidence", 0.0)
        x = s.get("open")
        if not x:
            x = s["open"] = {"text": text, "started": e["ms"], "confidence": confidence}
        else:
            x["confidence"] = max(0.0, min(1.0, (x["confidence"] + confidence) / 2))
            if text.startswith(x["text"]):
                x["text"] = text
            elif not x["text"].startswith(text):
                x["text"] = " ".join((x["text"][:-1] + text if x["text"].endswith("-") else x["text"] + " " + text).split())
        x.update(updated=e["ms"], event_id=e["event_id"])
        return out


class Queue(Live):
    """A server with a waiting line of ``most``: a full line drops its oldest; an event's ``work`` is its service time in ms.

    While the session is muted or inactive nothing waits: such an event clears the line.
    """

    states = {"server": ("value", "busy long"), "line": ("list", EVENT + ", work long")}

    def __init__(self, most: int = 2):
        self.most = most

    def due(self, s):
        return s["server"]["busy"] if s.get("line") else None

    def fire(self, s):
        e = s["line"].pop(0)
        at = s["server"]["busy"]
        s["server"] = {"busy": at + e["work"]}
        return [(at, "served", e["event_id"], e["text"])]

    def over(self, s, last):
        return None if s.get("line") else s["server"]["busy"] if s.get("server") else last + 1

    def on(self, s, e):
        if e["kind"] in ("muted", "inactive"):
            return [(e["ms"], "cleared", x["event_id"], x["text"]) for x in s.pop("line", [])]
        if not s.get("server") or s["server"]["busy"] <= e["ms"]:
            s["server"] = {"busy": e["ms"] + e["work"]}
            return [(e["ms"], "served", e["event_id"], e["text"])]
        line = s.setdefault("line", [])
        out = [(e["ms"], "dropped", line[0]["event_id"], line.pop(0)["text"])] if len(line) >= self.most else []
        line.append({k: e[k] for k in ("ms", "event_id", "text", "work")})
        return out


class RollingLatency(Live):
    """After each event the nearest-rank median (the score) and 95 % quantile (the text, in whole hundredths) of the last ``most`` levels of the session."""

    states = {"values": ("list", "value double")}

    def __init__(self, most: int = 300, rest_ms: int = 1_800_000):
        self.most, self.rest_ms = most, rest_ms

    def on(self, s, e):
        held = s.setdefault("values", [])
        held.append({"value": e["level"]})
        del held[: -self.most]
        ordered = sorted(x["value"] for x in held)
        at = lambda p: ordered[max(0, math.ceil(len(ordered) * p) - 1)]
        return [(e["ms"], "latency", e["event_id"], str(math.floor(at(0.95) * 100)), at(0.5))]


class Phases(Live):
    """The phase of a session: running, degraded and recovered, or error; changes are emitted. A session ends after ``rest_ms`` of silence."""

    states = {"phase": ("value", "name string")}

    def __init__(self, rest_ms: int = 1_800_000):
        self.rest_ms = rest_ms

    def on(self, s, e):
        phase, now = s.get("phase", {"name": "running"})["name"], e["kind"]
        if now == "degraded" or now == "error" and phase != "error":
            after = now
        elif now == "running" and phase == "degraded":
            after = "running"
        else:
            after = phase
        s["phase"] = {"name": after}
        return [(e["ms"], after, e["event_id"], "")] if after != phase else []


class SourceHealth(Live):
    """After ``silence_ms`` below the active level a better source is switched to, at most once in ``cooldown_ms``. A session ends after ``rest_ms`` without levels."""

    states = {"source": ("value", "heard long, switched long, suspect boolean")}

    def __init__(self, silence_ms: int = 4000, cooldown_ms: int = 8000, active: float = 70.0, least: float = 110.0, ratio: float = 1.35, rest_ms: int = 1_800_000):
        self.silence_ms, self.cooldown_ms, self.active, self.least, self.ratio, self.rest_ms = silence_ms, cooldown_ms, active, least, ratio, rest_ms

    def on(self, s, e):
        x = s.setdefault("source", {"heard": e["ms"], "switched": -10**15, "suspect": False})
        if e["level"] >= self.active:
            x["heard"] = e["ms"]
        silent = e["ms"] - x["heard"] >= self.silence_ms
        if silent and e["ms"] - x["switched"] >= self.cooldown_ms and e["other"] >= max(self.least, e["level"] * self.ratio):
            x.update(switched=e["ms"], heard=e["ms"])
            return [(e["ms"], "switch", e["event_id"], "")]
        if silent != x["suspect"]:
            x["suspect"] = silent
            return [(e["ms"], "suspect" if silent else "healthy", e["event_id"], "")]
        return []


class Throttle(Live):
    """Of events closer than ``every_ms`` to the last one that was let through none is."""

    states = {"passed": ("value", "ms long")}

    def __init__(self, every_ms: int = 250):
        self.every_ms = every_ms
        self.rest_ms = every_ms

    def on(self, s, e):
        if s.get("passed") and e["ms"] - s["passed"]["ms"] < self.every_ms:
            return []
        s["passed"] = {"ms": e["ms"]}
        return [(e["ms"], "passed", e["event_id"], "")]


def framed(rows: list[tuple]) -> pd.DataFrame:
    """Rows (user_id, ms, what, event_id, text) and, where there is one, a score."""
    return pd.DataFrame([(*r, *[float("nan")] * (6 - len(r))) for r in rows], columns=COLUMNS).astype({"score": "float64"})


def replay(events: DataFrame, fold: Live, flush: bool = False) -> DataFrame:
    """The same over a table; ``flush`` also fires what is open at the end.

    A user's events are cut at pauses after which the fold's state doesn't matter, so that groups are sessions and not users.
    """
    rows = events.withColumn("more", F.lit(flush))
    keys = ["user_id"]
    if fold.rest_ms is not None:
        from dialogmill.operators.turns import gap_sessions

        rows = gap_sessions(events, ["user_id"], "ms", fold.rest_ms)
        last = rows.groupBy("user_id").agg(F.max("session").alias("__last"))
        rows = rows.join(last, "user_id").withColumn("more", F.lit(flush) | (F.col("session") < F.col("__last"))).drop("__last")
        keys = ["user_id", "session"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, more, s = None, False, {}
        for frame in frames:
            out: list[tuple] = []
            for e in frame.drop(columns=["ts"]).to_dict("records"):
                own = tuple(e[k] for k in keys)
                if own != key:
                    if more:
                        out += [(key[0], *r) for r in fold.until(s, 1 << 62)]
                    key, s = own, {}
                more = e["more"]
                out += [(key[0], *r) for r in fold.run(s, [e])]
            yield framed(out)
        if more:
            yield framed([(key[0], *r) for r in fold.until(s, 1 << 62)])

    send_package(events.sparkSession)
    return rows.repartition(*keys).sortWithinPartitions(*keys, "ms", "event_id").mapInPandas(run, OUT)


def session_events(rows: DataFrame) -> DataFrame:
    """The events table as a live session: user_id, ts, ms, event_id, kind, text, level, other, work and levels; days shrink to seconds."""
    kind = F.when(F.col("event_id") % 41 == 40, "muted").otherwise(F.element_at(F.array(*map(F.lit, ["remote", "self", "diag"])), (F.col("event_id") % 3 + 1).cast("int")))
    text = F.concat(F.lit("word"), F.floor(F.col("value") / 100).cast("string"), F.when(F.col("event_id") % 4 == 0, ".").otherwise(" and"))
    return rows.select("user_id", "ts", F.floor(F.unix_millis("ts") / SCALE).alias("ms"), "event_id", kind.alias("kind"), text.alias("text"), F.col("value").alias("level"), (500 - F.col("value")).alias("other"), F.floor(F.col("value") * 2).alias("work"), F.col("value").alias("self_rms"), (500 - F.col("value")).alias("remote_rms"), (F.col("value") / 500).alias("confidence"))
