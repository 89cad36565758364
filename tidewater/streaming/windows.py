"""Triggered windows of a stream: state is the trigger's own and a partial value of each open window.

Rows count when they come. Within a micro-batch a key's rows come in order of event time
and tie-breaker. A window has a clock, the latest event time it has seen; a row
that comes late is in its window as any other and counts at the window's clock, so each
row is in exactly one DISCARDING pane, the one that is open when it comes, and in every
later ACCUMULATING one. Timers that are due by a row's time fire before the row.
Windows close when the watermark passes their end, or at the end of the stream (see
``close_windows``); empty panes are not given.

Sessions that a row joins become one: their values and triggers are merged, its pane id is
the earliest start, its firings are numbered on from the larger number (panes that were given before stay).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.triggers import Machine
from ..operators.windows import ACCUMULATING, DISCARDING
from ..session import ship_package
from .state import read_state
from .values import Value, number, total

STATE = "last bigint, clock bigint, pending bigint, given int, state binary"
PANE = ["key", "pane_id", "seq", "firing_type"]


class Spec:
    """What a window is: its kind, length or gap, values, early trigger and mode."""

    def __init__(self, kind: str, ms: int, values: dict[str, Value], trigger=None, mode: str = ACCUMULATING):
        if kind not in ("tumbling", "session") or ms < 1 or mode not in (DISCARDING, ACCUMULATING):
            raise ValueError(f"no {kind} windows of {ms} ms, {mode}")
        if kind == "session" and any(v.merge is None for v in values.values()):
            raise ValueError("a session's values need a merge")
        self.kind, self.ms, self.values, self.trigger, self.mode = kind, ms, values, trigger, mode


class Open:
    """An open window."""

    def __init__(self, spec: Spec, stored: tuple | None = None):
        self.spec, self.machine = spec, Machine(spec.trigger) if spec.trigger is not None else None
        if stored is None:
            self.last = self.clock = -(1 << 62)
            self.pending = self.given = 0  # rows since the last clearing; early firings
            self.held = [v.start() for v in spec.values.values()]
        else:
            self.last, self.clock, self.pending, self.given = stored[:4]
            machine, self.held = pickle.loads(bytes(stored[4]))
            if self.machine:
                self.machine.load(machine)

    def stored(self) -> tuple:
        return self.last, self.clock, self.pending, self.given, pickle.dumps((self.machine.dump() if self.machine else None, self.held))

    def end(self, start: int) -> int:
        return (start if self.spec.kind == "tumbling" else self.last) + self.spec.ms

    def due(self) -> int | None:
        return self.machine.next_due() if self.machine else None

    def join(self, other: Open) -> None:
        self.held = [v.merge(a, b) for v, a, b in zip(self.spec.values.values(), self.held, other.held, strict=True)]
        self.last, self.clock = max(self.last, other.last), max(self.clock, other.clock)
        self.pending, self.given = self.pending + other.pending, max(self.given, other.given)
        if self.machine:
            self.machine.merge(other.machine)

    def _pane(self, key, start: int, firing: str) -> list[tuple]:
        given, self.given = self.given, self.given + (firing == "EARLY")
        if not self.pending:
            return []
        out = (key, str(start), given, firing, *(v.result(x) for v, x in zip(self.spec.values.values(), self.held, strict=True)))
        if self.spec.mode == DISCARDING:
            self.pending, self.held = 0, [v.start() for v in self.spec.values.values()]
        return [out]

    def tick(self, key, start: int, now: int) -> list[tuple]:
        """Panes of the timers that are due by ``now``, before the window's end."""
        out = []
        while (due := self.due()) is not None and due <= now and due < self.end(start):
            if self.machine.tick(due):
                out += self._pane(key, start, "EARLY")
        return out

    def row(self, key, start: int, ms: int, row: dict) -> list[tuple]:
        self.clock, self.last = max(self.clock, ms), max(self.last, ms)
        out = self.tick(key, start, self.clock)
        self.held = [v.add(x, row) for v, x in zip(self.spec.values.values(), self.held, strict=True)]
        self.pending += 1
        if self.machine and self.machine.row(self.clock):
            out += self._pane(key, start, "EARLY")
        return out

    def close(self, key, start: int) -> list[tuple]:
        return self.tick(key, start, self.end(start)) + self._pane(key, start, "DEFAULT")


class TriggeredWindows(StatefulProcessor):
    """Columns: key, the event time, tw_ms, tw_tie and those of the values."""

    def __init__(self, spec: Spec, columns: list[str]):
        self.spec, self.columns = spec, columns
        self.names = [*PANE, *spec.values]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getMapState("open", "start bigint", STATE)

    def _all(self) -> dict[int, Open]:
        return {k[0]: Open(self.spec, tuple(v)) for k, v in self.open.iterator()}

    def _session(self, windows: dict[int, Open], at: int) -> int:
        """The session that a row at a time is in, made of all that it joins."""
        live = sorted(s for s, w in windows.items() if s - self.spec.ms <= at <= w.last + self.spec.ms)
        start = min([*live, at])
        if live and live != [start]:
            whole = windows.pop(live[0])
            self.open.removeKey((live[0],))
            for s in live[1:]:
                whole.join(windows.pop(s))
                self.open.removeKey((s,))
            windows[start] = whole
        return start

    def _tumbling(self, windows: dict[int, Open], at: int) -> int:
        start = at - at % self.spec.ms
        if start not in windows and self.open.containsKey((start,)):
            windows[start] = Open(self.spec, tuple(self.open.getValue((start,))))
        return start

    def _keep(self, start: int, window: Open) -> None:
        self.open.updateValue((start,), window.stored())
        self.handle.registerTimer(window.end(start))
        due = window.due()
        if due is not None and due < window.end(start):
            self.handle.registerTimer(max(due, 0))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [pdf for pdf in rows if len(pdf)]  # a call may be without rows
        frame = pd.concat(parts, ignore_index=True).sort_values(["tw_ms", "tw_tie"], kind="stable") if parts else pd.DataFrame(columns=self.columns)
        session = self.spec.kind == "session"
        windows, touched, out = self._all() if session else {}, set(), []
        for values in zip(*(frame[c].tolist() for c in self.columns), strict=True):
            row = dict(zip(self.columns, values, strict=True))
            at = int(row["tw_ms"])
            start = self._session(windows, at) if session else self._tumbling(windows, at)
            out += windows.setdefault(start, Open(self.spec)).row(key[0], start, at, row)
            touched.add(start)
        for start in sorted(touched & windows.keys()):
            self._keep(start, windows[start])
        yield pd.DataFrame(out, columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentWatermarkInMs(), []
        for start, window in sorted(self._all().items()):
            if window.end(start) <= now:
                out += window.close(key[0], start)
                self.open.removeKey((start,))
            elif (due := window.due()) is not None and due <= now:
                window.clock = max(window.clock, now)
                out += window.tick(key[0], start, now)
                self._keep(start, window)
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def _schema(kind: str, spec: Spec) -> str:
    return ", ".join([f"key {kind}, pane_id string, seq long, firing_type string", *(f"`{k}` {v.ddl}" for k, v in spec.values.items())])


def window_stream(df: DataFrame, kind: str, ms: int, key: str, time: str, tie: str, values: dict[str, Value] | str, trigger=None, mode: str = ACCUMULATING) -> DataFrame:
    """Panes (key, pane_id, seq, firing_type and the values) of a stream that has a watermark on ``time``. A column's name for ``values`` stands for n, the number of rows, and total, its sum."""
    ship_package(df.sparkSession)
    spec = Spec(kind, ms, {"n": number(), "total": total(values)} if isinstance(values, str) else values, trigger, mode)
    wanted = list(dict.fromkeys(c for v in spec.values.values() for c in v.columns))
    own = [F.col(key).alias("tw_key"), F.col(time).alias("tw_time"), F.unix_millis(F.col(time).cast("timestamp")).alias("tw_ms"), F.col(tie).cast("long").alias("tw_tie")]
    rows = df.where(F.col(time).isNotNull()).select(*own, *wanted)
    processor = TriggeredWindows(spec, ["tw_ms", "tw_tie", *wanted])
    return rows.groupBy("tw_key").transformWithStateInPandas(processor, _schema(rows.schema["tw_key"].dataType.simpleString(), spec), "Append", "EventTime")


def close_windows(spark: SparkSession, checkpoint: str, panes: DataFrame, kind: str, ms: int, values: dict[str, Value] | str, trigger=None, mode: str = ACCUMULATING) -> DataFrame:
    """The end of the stream: last panes of the windows that a query, which has ended, left open in its checkpoint. ``panes`` is the frame that the query wrote."""
    ship_package(spark)
    spec = Spec(kind, ms, {"n": number(), "total": total(values)} if isinstance(values, str) else values, trigger, mode)
    names = [*PANE, *spec.values]
    left = read_state(spark, checkpoint, "open").select(F.col("key.tw_key").alias("key"), F.col("user_map_key.start").alias("start"), "user_map_value.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, start, *stored in zip(*(pdf[c].tolist() for c in pdf.columns), strict=True):
                out += Open(spec, tuple(stored)).close(key, start)
            yield pd.DataFrame(out, columns=names)

    return left.mapInPandas(run, panes.schema)
