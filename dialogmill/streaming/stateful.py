"""Folds of live sessions as streams: arbitrary state on RocksDB, with typed variables and event-time timers.

Events wait in a list until the watermark has passed their time, so neither the order in which they come nor the cut into batches matters;
then the fold runs over them in order. One timer of a key stands at the earliest time at which something can happen: a waiting event, a deadline of the
fold, or the end of its rest, when all state of the key is dropped. So the state holds what is open, not every key that was ever seen.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from dialogmill.streaming import live
from dialogmill.streaming.live import COLUMNS, LATE, OUT, Live

#: What a query with these operators needs; given to run.available_now().
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


class FoldProcessor(StatefulProcessor):
    """Runs a fold over the events of each key; ``scale`` is how many ms of event time make one of the events' ms."""

    def __init__(self, fold: Live, fields: str, scale: int = 1):
        self.fold, self.fields, self.scale = fold, fields, scale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.doubles = [field.split()[0] for field in self.fields.split(", ") if field.endswith(" double")]
        # a row of arrays for each batch, as every value of a state passes from Python to the store by itself
        self.waiting = handle.getListState("waiting", "ms array<long>, event array<string>")
        self.clock = handle.getValueState("clock", "timer long, last long")
        self.states = {}
        for name, (kind, schema) in self.fold.states.items():
            if kind == "map":
                self.states[name] = handle.getMapState(name, "k string", schema)
            else:
                self.states[name] = (handle.getListState if kind == "list" else handle.getValueState)(name, schema)

    def read(self, event: str) -> dict:
        out = json.loads(event)
        for name in self.doubles:
            if isinstance(out[name], str):  # "NaN" and "Infinity"
                out[name] = float(out[name])
        return out

    def load(self) -> dict:
        out = {}
        for name, (kind, schema) in self.fold.states.items():
            state, names = self.states[name], _names(schema)
            if kind == "value":
                if (row := state.get()) is not None:
                    out[name] = dict(zip(names, row, strict=True))
            elif not state.exists():
                continue
            elif kind == "list":
                out[name] = [dict(zip(names, row, strict=True)) for row in state.get()]
            else:
                out[name] = {key[0]: dict(zip(names, row, strict=True)) for key, row in state.iterator()}
        return out

    def save(self, s: dict, before: set[str]) -> None:
        """``before``: the variables that load() has found."""
        for name, (kind, schema) in self.fold.states.items():
            state, names, now = self.states[name], _names(schema), s.get(name)
            if not now:
                if name in before:
                    state.clear()
            elif kind == "value":
                state.update(tuple(now[n] for n in names))
            elif kind == "list":
                state.put([tuple(x[n] for n in names) for x in now])
            else:
                for key in [key for key in state.keys() if key[0] not in now]:
                    state.removeKey(key)
                for key, x in now.items():
                    state.updateValue((key,), tuple(x[n] for n in names))

    def schedule(self, ms: int, timer: int | None, last: int | None) -> None:
        """A timer that goes off when the watermark has passed all of ``ms``, if the one that stands is later."""
        at = (ms + 1) * self.scale - 1
        if timer is not None and timer <= at:
            at = timer
        else:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)
        self.clock.update((at, last))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        rows = list(rows)
        times, events = ([row[c] for row in rows] for c in ("ms", "event"))
        self.waiting.appendList([(times, events)])
        timer, last = self.clock.get() or (None, None)
        self.schedule(min(times), timer, last)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() // self.scale - 1  # this ms and all before are complete
        waiting = [e for batch in self.waiting.get() for e in zip(*batch, strict=True)] if self.waiting.exists() else []
        ready = sorted((self.read(event) for ms, event in waiting if ms <= now), key=lambda e: (e["ms"], e["event_id"]))
        later = [(ms, event) for ms, event in waiting if ms > now]
        _, last = self.clock.get()
        s = self.load()
        before = set(s)
        out = self.fold.run(s, ready, last) + self.fold.until(s, now)
        last = ready[-1]["ms"] if ready else last
        over = self.fold.over(s, last)
        ended = not later and self.fold.due(s) is None and over is not None and over <= now
        self.save({} if ended else s, before)
        if ready and later:
            self.waiting.put([tuple(map(list, zip(*later, strict=True)))])
        elif ready:
            self.waiting.clear()
        times = [t for t in (min((ms for ms, _ in later), default=None), self.fold.due(s), over) if t is not None]
        if ended:
            self.clock.clear()
        elif times:
            self.schedule(max(min(times), now + 1), None, last)
        else:
            self.clock.update((None, last))
        for row in out:
            yield Row(**dict(zip(COLUMNS, (key[0], *row, *[None] * (5 - len(row))), strict=True)))


def stream(events: DataFrame, fold: Live, scale: int = 1, late: str = LATE) -> DataFrame:
    """events: user_id, ts, ms, event_id and the fold's fields, as a stream; ms is ts in milliseconds over ``scale``."""
    for module in (live, sys.modules[__name__]):  # a streaming query also runs it in a process at the driver, which gets no added files
        cloudpickle.register_pickle_by_value(module)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema if f.name not in ("user_id", "ts"))
    # one text an event: what passes to Python costs by the value
    event = F.to_json(F.struct(*[c for c in events.columns if c not in ("user_id", "ts")]), {"ignoreNullFields": "false"})
    return events.select("user_id", "ts", "ms", event.alias("event")).withWatermark("ts", late).groupBy("user_id").transformWithState(FoldProcessor(fold, fields, scale), OUT, "Append", "EventTime")
