"""Keyed state and timers with transformWithState: the latest-row join and tasks.

Micro-batches follow each other in arrival order; within one, the join handles a key's
rows in order of event time and tie-breaker, so a replay in time order gives what the
bounded operators give. State lives in RocksDB and is checkpointed with the query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..session import ship_package
from .ordered import OrderedMap
from .state import read_state
from .time import to_event_time


def _ordered(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    parts = list(rows)
    out = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame()
    return out.sort_values(by, kind="stable") if by and len(out) else out


class LatestJoin(StatefulProcessor):
    """State: the latest row of either side. Columns: key, side (0, 1), ms, tie, value (the row as JSON).

    With ``evict``, a row leaves when the watermark has passed its time and the ttl: what comes
    later can't match it.
    """

    def __init__(self, ttl_ms: int, evict: bool):
        self.ttl, self.evict = ttl_ms, evict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sides = [handle.getValueState(f"side{i}", "ms bigint, value string") for i in (0, 1)]
        self.timer = handle.getValueState("timer", "ms bigint")

    def _remind(self, due: list[int]) -> None:
        """One timer a key, at the first time at which a row can leave."""
        if due:
            self.timer.update((min(due),))
            self.handle.registerTimer(min(due))
        else:
            self.timer.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        latest = [s.get() if s.exists() else None for s in self.sides]
        for r in _ordered(rows, ["ms", "tie", "side"]).itertuples():
            latest[r.side] = (r.ms, r.value)
            other = latest[1 - r.side]
            if other is not None and other[0] > r.ms - self.ttl:
                pair = (r.value, other[1]) if r.side == 0 else (other[1], r.value)
                out.append((key[0], *pair, r.ms))
        for state, value in zip(self.sides, latest, strict=True):
            if value is not None:
                state.update((int(value[0]), value[1]))
        if self.evict and not self.timer.exists():
            self._remind([int(x[0]) + self.ttl for x in latest if x is not None])
        yield pd.DataFrame(out, columns=["key", "left", "right", "ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, due = timerValues.getCurrentWatermarkInMs(), []
        for state in self.sides:
            if state.exists():
                at = state.get()[0] + self.ttl
                if at <= now:
                    state.clear()
                else:
                    due.append(at)
        self._remind(due)
        yield pd.DataFrame([], columns=["key", "left", "right", "ms"])

    def close(self) -> None:
        pass


def _millis(time: str):
    return F.unix_millis(F.col(time).cast("timestamp"))


def join_streams(left: DataFrame, right: DataFrame, key: str, time: str, tie: str, ttl_ms: int, delay: str | None = "0 seconds") -> DataFrame:
    """The time-bounded latest-row join of two streams: key, left and right rows in JSON, ms of the match.

    Both streams get a watermark of ``delay``, and the smaller of the two counts: rows that come
    later than it by either are dropped, and state leaves when the ttl has passed by it. So
    ``delay`` is how far rows may be out of order. Without (None) nothing is late and all state stays.
    """
    ship_package(left.sparkSession)
    sides = []
    for i, df in enumerate((left, right)):
        timed = (to_event_time(df, time, delay) if delay is not None else df).where(F.col(key).isNotNull() & F.col(time).isNotNull())
        sides.append(timed.select(F.col(key).alias("key"), F.col(time).cast("timestamp").alias("_time") if delay is None else F.col(time).alias("_time"), F.lit(i).alias("side"), _millis(time).alias("ms"), F.col(tie).cast("long").alias("tie"), F.to_json(F.struct(*df.columns)).alias("value")))
    both = sides[0].unionByName(sides[1])
    kind = both.schema["key"].dataType.simpleString()
    return both.groupBy("key").transformWithStateInPandas(LatestJoin(ttl_ms, delay is not None), f"key {kind}, left string, right string, ms long", "Append", "None" if delay is None else "EventTime")


class Task:
    """Imperative code for each key: override what is needed. ``store`` is the key's own ordered map of strings (of bytes with ``binary``).

    ``window`` runs by the clock, ``watermark`` when the event-time watermark has passed a
    time that ``process`` asked for by ``store.remind(ms)``, ``end`` at the end of the stream (see
    ``end_task``). ``setup`` and ``teardown`` enclose what one process does of a partition. A
    micro-batch is what is committed; ``runs.run_until_shutdown`` ends a query that a row asks to end.
    """

    binary = False

    def setup(self) -> None: ...

    def process(self, key, row, store) -> list[tuple]:
        raise NotImplementedError

    def bootstrap(self, key, row, store) -> None:
        """Called for each row of the bootstrap input, all of a key's before ``process`` gets its first row."""

    def window(self, key, store) -> list[tuple]:
        """Called when the key's timer fires."""
        return []

    def watermark(self, key, ms: int, store) -> list[tuple]:
        """Called when the watermark has passed ``ms``."""
        return []

    def end(self, key, store) -> list[tuple]:
        """Called for each key with state at the end of the stream; what it puts into the store is lost."""
        return []

    def teardown(self) -> None: ...


class _TaskProcessor(StatefulProcessor):
    def __init__(self, task: Task, columns: list[str], every_ms: int | None, event_time: bool, order: list[str]):
        self.task, self.columns, self.every, self.event_time, self.order = task, columns, every_ms, event_time, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.store = handle, TaskStore(OrderedMap(handle), handle, self.task.binary)
        self.task.setup()

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        self.store.entries.flush()
        return pd.DataFrame(out, columns=self.columns)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.store.entries.begin()
        for r in _ordered(iter([initialState]), [c for c in self.order if c in initialState.columns]).itertuples(index=False):
            self.task.bootstrap(key[0], r, self.store)
        self.store.entries.flush()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        self.store.entries.begin()
        for r in _ordered(rows, self.order).itertuples(index=False):
            out += self.task.process(key[0], r, self.store)
        if self.every and not list(self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.every)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.store.entries.begin()
        if self.event_time:
            yield self._frame(self.task.watermark(key[0], expiredTimerInfo.getExpiryTimeInMs(), self.store))
            return
        out = self.task.window(key[0], self.store)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.every)
        yield self._frame(out)

    def close(self) -> None:
        self.task.teardown()


class TaskStore:
    """An ordered map of strings: get, get_all, put, put_all, delete, delete_all, range, all. With ``binary``, values are bytes."""

    def __init__(self, entries: OrderedMap, handle=None, binary: bool = False):
        self.entries, self.handle, self.binary = entries, handle, binary

    def _value(self, v: bytes | None):
        return v if v is None or self.binary else v.decode()

    def remind(self, ms: int) -> None:
        """Ask for ``Task.watermark`` when event time has passed ``ms``."""
        self.handle.registerTimer(ms)

    def get(self, k: str) -> str | bytes | None:
        return self._value(self.entries.get(k.encode()))

    def get_all(self, keys: list[str]) -> dict[str, str | bytes | None]:
        return {k: self.get(k) for k in keys}

    def put(self, k: str, v: str | bytes | None) -> None:
        if k is None:
            raise ValueError("a key is not null")
        if v is None:
            self.delete(k)
        else:
            self.entries.put(k.encode(), v if self.binary else v.encode())

    def put_all(self, entries: dict[str, str | bytes | None]) -> None:
        for k, v in entries.items():
            self.put(k, v)

    def delete(self, k: str) -> None:
        self.entries.remove(k.encode())

    def delete_all(self, keys: list[str]) -> None:
        for k in keys:
            self.delete(k)

    def delete_range(self, start: str, stop: str) -> None:
        """All from ``start`` to below ``stop``."""
        self.entries.remove_range(start.encode(), stop.encode())

    def all(self) -> list[tuple[str, str | bytes]]:
        return [(k.decode(), self._value(v)) for k, v in self.entries.range()]

    def range(self, start: str, stop: str) -> list[tuple[str, str | bytes]]:
        """Entries from ``start`` to below ``stop``, in order."""
        return [(k.decode(), self._value(v)) for k, v in self.entries.range(start.encode(), stop.encode())]


def run_task(
    df: DataFrame, key: str, task: Task, schema: str, every_ms: int | None = None, event_time: bool = False, order: list[str] | None = None, bootstrap: DataFrame | None = None
) -> DataFrame:
    """A task over a keyed stream (or a bounded frame): its rows, each with the columns of ``schema``. With ``order``, a key's rows of a micro-batch come sorted by these columns.

    ``bootstrap`` is a bounded frame with the key, such as what a stream's source holds now: its
    rows go to ``Task.bootstrap`` before the query's first rows, and not again when it is restarted.
    """
    ship_package(df.sparkSession)
    names = StructType.fromDDL(schema).names
    return df.groupBy(key).transformWithStateInPandas(_TaskProcessor(task, names, every_ms, event_time, order or []), schema, "Append", "EventTime" if event_time else "ProcessingTime" if every_ms else "None", initialState=bootstrap.groupBy(key) if bootstrap is not None else None)


class PlainMap:
    """What ``OrderedMap`` does, over a dictionary: of a key that has ended, or in tests of a task."""

    def __init__(self, entries: dict[bytes, bytes]):
        self.entries = entries

    def get(self, key: bytes) -> bytes | None:
        return self.entries.get(key)

    def put(self, key: bytes, value: bytes) -> None:
        self.entries[key] = value

    def remove(self, key: bytes) -> None:
        self.entries.pop(key, None)

    def remove_range(self, start: bytes, stop: bytes | None) -> None:
        for k, _ in list(self.range(start, stop)):
            del self.entries[k]

    def range(self, start: bytes = b"", stop: bytes | None = None) -> Iterator[tuple[bytes, bytes]]:
        return iter([(k, self.entries[k]) for k in sorted(self.entries) if k >= start and (stop is None or k < stop)])


def end_task(spark: SparkSession, checkpoint: str, key: str, task: Task, schema: str) -> DataFrame:
    """The end of the stream: what ``task.end`` gives for each key whose state a query, which has ended, left in its checkpoint."""
    ship_package(spark)
    names = StructType.fromDDL(schema).names
    left = read_state(spark, checkpoint, "entries_buckets").select(F.col(f"key.{key}").alias("key"), "user_map_value.*")

    def run(of: tuple, found: pd.DataFrame) -> pd.DataFrame:
        entries = {bytes(k): bytes(v) for keys, vals in zip(found["keys"], found["vals"], strict=True) for k, v in zip(keys, vals, strict=True)}
        task.setup()
        out = task.end(of[0], TaskStore(PlainMap(entries), binary=task.binary))
        task.teardown()
        return pd.DataFrame(out, columns=names)

    return left.groupBy("key").applyInPandas(run, schema)


__all__ = ["LatestJoin", "PlainMap", "Task", "TaskStore", "end_task", "join_streams", "run_task"]
