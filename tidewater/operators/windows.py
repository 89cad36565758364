"""Tumbling, hopping and session windows with early triggers, over event time.

A window gives panes: (key, pane_id, window_start, window_end, seq, firing_type, mode) and
values. DEFAULT panes come at a window's end (for a session: when no row came for the
gap), EARLY ones when the trigger fires. DISCARDING panes hold the rows since the last
firing, ACCUMULATING ones all rows so far; an unset mode accumulates. Empty panes are not
emitted. A late trigger is accepted and never fires.

Values are built-in aggregates (partial sums before the shuffle), ``Partial`` (the same,
with how its parts are merged), ``Collect`` (rows in order) or ``Fold`` (an expression over
rows in order). Windows without an early trigger are plain grouped aggregates; of hopping
ones over a row for each window that holds it, or, if all values are ``Partial``, for each
slide and window. Count triggers are arithmetic on row numbers. Other triggers are replayed
over the arrival times of one window (8 bytes a row).

Sessions are found without ordering rows: rows of a key in one slot of the gap's length are of one
session, so each slot is summed up first; slots are put together in chunks of ``CHUNK``, and of
each chunk only its first and last run meet those of the others. Neither a hot key nor
all rows (a session without keys) are in one task. Rows are joined with their slot's session only
if a value isn't ``Partial`` or there is an early trigger.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship_package
from .triggers import Count, Repeat, firings

DISCARDING, ACCUMULATING = "DISCARDING", "ACCUMULATING"
#: Slots of the gap's length that are put together at a time.
CHUNK = 4096


@dataclass(frozen=True)
class Partial:
    """An aggregate in steps: ``first`` over rows, ``merge`` over columns of such values."""

    first: Column
    merge: Callable[[Column], Column]


def count_rows() -> Partial:
    return Partial(F.count(F.lit(1)), F.sum)


def sum_of(column: Column | str) -> Partial:
    return Partial(F.sum(column), F.sum)


def least_of(column: Column | str) -> Partial:
    return Partial(F.min(column), F.min)


def most_of(column: Column | str) -> Partial:
    return Partial(F.max(column), F.max)


@dataclass(frozen=True)
class Collect:
    """The rows of a pane, in order of time and tie, as an array of structs."""

    columns: tuple[str, ...]


@dataclass(frozen=True)
class Fold:
    """``merge(old, row)`` over the rows of a pane in order, from ``initial``."""

    columns: tuple[str, ...]
    initial: Column
    merge: Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Window:
    kind: str
    ms: int
    keys: tuple[str, ...] = ()
    values: dict[str, object] = field(default_factory=dict)
    early: object | None = None
    late: object | None = None
    mode: str | None = None
    slide: int | None = None

    def agg(self, **values: object) -> Window:
        """Named values: aggregate columns, Collect or Fold."""
        return replace(self, values=self.values | values)

    def early_trigger(self, trigger) -> Window:
        return replace(self, early=trigger)

    def late_trigger(self, trigger) -> Window:
        return replace(self, late=trigger)

    def accumulate(self, mode: str) -> Window:
        if mode not in (DISCARDING, ACCUMULATING):
            raise ValueError(f"no mode {mode}")
        return replace(self, mode=mode)


def tumbling_window(ms: int, *keys: str) -> Window:
    """Windows of a fixed length from the epoch on; without keys, one for all rows."""
    if ms < 1:
        raise ValueError("a window is at least 1 ms long")
    return Window("tumbling", ms, keys)


def hopping_window(ms: int, slide_ms: int, *keys: str) -> Window:
    """Windows of a fixed length that begin every ``slide_ms`` from the epoch on; a row is in each that holds it."""
    if not 1 <= slide_ms <= ms:
        raise ValueError("a window slides by 1 ms at least and by its length at most")
    return Window("hopping", ms, keys, slide=slide_ms)


def session_window(gap_ms: int, *keys: str) -> Window:
    """Sessions of a key; a row at most the gap after the last extends its session."""
    if gap_ms < 1:
        raise ValueError("a gap is at least 1 ms long")
    return Window("session", gap_ms, keys)


def _length(ms: int) -> Column:
    return F.make_dt_interval(secs=F.lit(ms).cast("decimal(18,6)") / 1000)


def _assign(df: DataFrame, spec: Window, time: str) -> DataFrame:
    """Rows with _start and _end of their window."""
    if spec.kind == "session":
        return _in_sessions(df, spec, time)
    start = F.window(time, f"{spec.ms} milliseconds", f"{spec.slide or spec.ms} milliseconds")["start"]
    return df.withColumn("_start", start.cast(df.schema[time].dataType)).withColumn("_end", F.col("_start") + _length(spec.ms))


def _slots(df: DataFrame, spec: Window, time: str) -> DataFrame:
    """Rows with the number of the slot, as long as the gap, that they are in."""
    micros, gap = _units(df, time, "MICROSECOND"), F.lit(spec.ms * 1000)
    return df.withColumn("_slot", F.call_function("div", micros - F.pmod(micros, gap), gap))


def _runs(slots: DataFrame, spec: Window, held: Callable[[], list[Column]]) -> DataFrame:
    """Slots (keys, _slot, _lo, _hi) put together as far as their chunk goes: _chunk, _run and what ``held`` makes of each run's columns."""
    order = W.partitionBy(*spec.keys, "_chunk").orderBy("_slot")
    new = F.lag("_hi").over(order).isNull() | (F.col("_lo") > F.lag("_hi").over(order) + _length(spec.ms))
    out = slots.withColumn("_chunk", F.floor(F.col("_slot") / CHUNK)).withColumn("_new", new.cast("long"))
    out = out.withColumn("_run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return out.groupBy(*spec.keys, "_chunk", "_run").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), *held())


def _stitched(runs: DataFrame, spec: Window) -> tuple[DataFrame, list[str]]:
    """Runs with the numbers of their session, which are of a key's outermost runs together and of the others by chunk."""
    chunk = W.partitionBy(*spec.keys, "_chunk")
    outer = (F.col("_run") == 1) | (F.col("_run") == F.max("_run").over(chunk))
    runs = runs.withColumn("_part", F.when(outer, F.lit(None)).otherwise(F.col("_chunk")))
    order = W.partitionBy(*spec.keys, "_part").orderBy("_chunk", "_run")
    new = F.lag("_hi").over(order).isNull() | (F.col("_lo") > F.lag("_hi").over(order) + _length(spec.ms))
    runs = runs.withColumn("_new", new.cast("long"))
    return runs.withColumn("_session", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))), [*spec.keys, "_part", "_session"]


def _bounds(spec: Window) -> list[Column]:
    return [F.min("_lo").alias("_start"), (F.max("_hi") + _length(spec.ms)).alias("_end")]


def _session_values(df: DataFrame, spec: Window, time: str) -> DataFrame:
    """Keys, _start, _end and merged values (_v0, _v1, ...) of all sessions."""
    values = list(spec.values.values())
    merged = lambda: [v.merge(F.col(f"_v{i}")).alias(f"_v{i}") for i, v in enumerate(values)]
    slots = _slots(df, spec, time).groupBy(*spec.keys, "_slot").agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"), *[v.first.alias(f"_v{i}") for i, v in enumerate(values)])
    runs, session = _stitched(_runs(slots, spec, merged), spec)
    return runs.groupBy(*session).agg(*_bounds(spec), *merged())


def _in_sessions(df: DataFrame, spec: Window, time: str) -> DataFrame:
    """Rows with _start and _end of their session."""
    rows = _slots(df, spec, time)
    slots = rows.groupBy(*spec.keys, "_slot").agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    runs, session = _stitched(_runs(slots, spec, lambda: [F.collect_list("_slot").alias("_slots")]), spec)
    whole = W.partitionBy(*session)
    found = runs.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(spec.keys)], F.explode("_slots").alias("_of"), F.min("_lo").over(whole).alias("_start"), (F.max("_hi").over(whole) + _length(spec.ms)).alias("_end"))
    same = F.col("_slot") == F.col("_of")
    for i, k in enumerate(spec.keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(found, same).drop("_slot", "_of", *[f"_k{i}" for i in range(len(spec.keys))])


def _hops(df: DataFrame, spec: Window, time: str) -> DataFrame:
    """Keys, _start, _end and merged values of hopping windows, summed up by slide first."""
    values = list(spec.values.values())
    start = F.window(time, f"{spec.slide} milliseconds")["start"].cast(df.schema[time].dataType)
    slides = df.groupBy(*spec.keys, start.alias("_slide")).agg(*[v.first.alias(f"_v{i}") for i, v in enumerate(values)])
    back = F.explode(F.transform(F.sequence(F.lit(0), F.lit(spec.ms // spec.slide - 1)), lambda k: F.col("_slide") - F.make_dt_interval(secs=k * F.lit(spec.slide).cast("decimal(18,6)") / 1000)))
    out = slides.withColumn("_start", back).groupBy(*spec.keys, "_start").agg(*[v.merge(F.col(f"_v{i}")).alias(f"_v{i}") for i, v in enumerate(values)])
    return out.withColumn("_end", F.col("_start") + _length(spec.ms))


def _value(value, time: str, tie: str, over=None) -> Column:
    if isinstance(value, Partial):
        value = value.first
    if isinstance(value, (Collect, Fold)):
        rows = F.collect_list(F.struct(F.col(time).alias("_t"), F.col(tie).alias("_tie"), F.struct(*value.columns).alias("_row")))
        ordered = F.transform(F.array_sort(rows.over(over) if over is not None else rows), lambda x: x["_row"])
        return F.aggregate(ordered, value.initial, value.merge) if isinstance(value, Fold) else ordered
    return value.over(over) if over is not None else value


def _units(df: DataFrame, column: str, unit: str) -> Column:
    """Whole units since the epoch; a time without zone is taken as UTC whatever the session's zone."""
    if df.schema[column].dataType.typeName() == "timestamp_ntz":
        return F.timestamp_diff(unit, F.lit("1970-01-01").cast("timestamp_ntz"), F.col(column))
    return F.unix_millis(column) if unit == "MILLISECOND" else F.unix_micros(column)


def _millis(df: DataFrame, column: str) -> Column:
    return _units(df, column, "MILLISECOND")


def _panes(df: DataFrame, spec: Window, seq, firing) -> DataFrame:
    return df.withColumns({"_p_pane_id": _millis(df, "_start").cast("string"), "_p_seq": seq, "_p_firing_type": firing, "_p_mode": F.lit(spec.mode or ACCUMULATING)})


def panes(df: DataFrame, spec: Window, time: str, tie: str) -> DataFrame:
    """All panes of a bounded frame; its end flushes every open window."""
    names = dict(spec.values)
    if not names:
        raise ValueError("a window needs a value")
    rows = df.where(F.col(time).isNotNull())
    group = [*spec.keys, "_start", "_end"]
    pane = [F.col(f"_p_{c}").alias(c) for c in ("pane_id", "seq", "firing_type", "mode")]
    values = [F.col(f"_v{i}").alias(k) for i, k in enumerate(names)]
    final = [*spec.keys, pane[0], F.col("_start").alias("window_start"), F.col("_end").alias("window_end"), *pane[1:], *values]
    if spec.early is None and all(isinstance(v, Partial) for v in names.values()) and (spec.kind == "session" or spec.slide and spec.ms % spec.slide == 0):
        out = (_session_values if spec.kind == "session" else _hops)(rows, spec, time)
        return _panes(out, spec, F.lit(0).cast("long"), F.lit("DEFAULT")).select(*final)
    rows = _assign(rows, spec, time)
    if spec.early is None:
        out = rows.groupBy(*group).agg(*[_value(v, time, tie).alias(f"_v{i}") for i, v in enumerate(names.values())])
        return _panes(out, spec, F.lit(0).cast("long"), F.lit("DEFAULT")).select(*final)
    order = W.partitionBy(*group).orderBy(time, tie)
    rows = rows.withColumn("_rn", F.row_number().over(order)).withColumn("_cnt", F.count(F.lit(1)).over(W.partitionBy(*group)))
    n = spec.early.trigger.n if isinstance(spec.early, Repeat) and isinstance(spec.early.trigger, Count) else None
    if n:
        fires, before, last = F.when(F.col("_rn") % n == 0, F.array("_rn")), F.floor((F.col("_rn") - 1) / n), F.floor(F.col("_cnt") / n)
    elif isinstance(spec.early, Count):
        n = spec.early.n
        fires, before, last = F.when(F.col("_rn") == n, F.array("_rn")), F.when(F.col("_rn") > n, 1).otherwise(0), F.when(F.col("_cnt") >= n, 1).otherwise(0)
    else:
        trigger = spec.early
        ship_package(df.sparkSession)

        @F.pandas_udf("array<int>")
        def replay(times: pd.Series, ends: pd.Series) -> pd.Series:
            return pd.Series([firings(trigger, list(t), int(e)) for t, e in zip(times, ends, strict=True)])

        fired = rows.groupBy(*group).agg(F.array_sort(F.collect_list(_millis(rows, time))).alias("_times"), F.first(_millis(rows, "_end")).alias("_last")).select(*group, replay("_times", F.col("_last")).alias("_fires"))
        # A firing becomes a row beside the row that it follows; sums in order of row numbers give each row the firings at it, before it and of its window.
        marks = fired.select(*group, F.explode("_fires").alias("_rn"), F.lit(1).alias("_mark"))
        both = rows.withColumn("_mark", F.lit(0)).unionByName(marks, allowMissingColumns=True)
        by = W.partitionBy(*group)
        at, ahead = by.orderBy("_rn").rangeBetween(0, 0), by.orderBy("_rn").rangeBetween(W.unboundedPreceding, -1)
        sums = {"_at": F.sum("_mark").over(at), "_before": F.coalesce(F.sum("_mark").over(ahead), F.lit(0)), "_all": F.sum("_mark").over(by)}
        rows = both.withColumns(sums).where("_mark = 0").drop("_mark")
        fires, before, last = F.when(F.col("_at") > 0, F.array_repeat("_rn", F.col("_at").cast("int"))), F.col("_before"), F.col("_all")
    if spec.mode == DISCARDING:
        rows = rows.withColumn("_seq", before.cast("long")).withColumn("_early", before < last)
        out = rows.groupBy(*group, "_seq", "_early").agg(*[_value(v, time, tie).alias(f"_v{i}") for i, v in enumerate(names.values())])
        return _panes(out, spec, F.col("_seq"), F.when(F.col("_early"), "EARLY").otherwise("DEFAULT")).select(*final)
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    quick = {i: v for i, v in enumerate(names.values()) if not isinstance(v, (Collect, Fold))}
    rows = rows.withColumns({f"_v{i}": _value(v, time, tie, so_far) for i, v in quick.items()})
    early = F.transform(F.coalesce(fires, F.array().cast("array<int>")), lambda _, i: F.struct((before + i).cast("long").alias("seq"), F.lit("EARLY").alias("firing_type")))
    default = F.when(F.col("_rn") == F.col("_cnt"), F.array(F.struct(last.cast("long").alias("seq"), F.lit("DEFAULT").alias("firing_type")))).otherwise(F.array().cast("array<struct<seq:bigint,firing_type:string>>"))
    rows = rows.withColumn("_pane", F.concat(early, default))
    slow = {i: v for i, v in enumerate(names.values()) if i not in quick}
    if slow:
        rows = _prefixes(rows, group, quick, slow)
    out = rows.where(F.size("_pane") > 0).withColumn("_pane", F.explode("_pane"))
    return _panes(out, spec, F.col("_pane.seq"), F.col("_pane.firing_type")).select(*final)


#: States of a fold that are put into one array before it is closed.
OPEN = 512


def _prefixes(rows: DataFrame, group: list[str], quick: dict[int, object], slow: dict[int, object]) -> DataFrame:
    """The rows of a window that fire, with the values over all its rows up to them: the window's rows are ordered once, and a fold goes over them once."""
    fires = F.size("_pane") > 0
    parts = [F.struct(*v.columns).alias(f"_row{i}") for i, v in slow.items()]
    mine = F.struct("_pane", "_rn", *[f"_v{i}" for i in quick])
    whole = rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_rn", F.when(fires, mine).alias("_mine"), *parts))).alias("_rows"))

    def states(i: int, fold: Fold) -> Column:
        none = F.filter(F.array(fold.initial), lambda _: F.lit(False))
        start = F.struct(fold.initial.alias("state"), F.filter(F.array(none), lambda _: F.lit(False)).alias("full"), none.alias("open"))

        def step(held: Column, row: Column) -> Column:
            state = fold.merge(held["state"], row[f"_row{i}"])
            fired, closes = row["_mine"].isNotNull(), F.size(held["open"]) == OPEN
            full = F.when(fired & closes, F.concat(held["full"], F.array(held["open"]))).otherwise(held["full"])
            now = F.when(fired, F.concat(F.when(closes, none).otherwise(held["open"]), F.array(state))).otherwise(held["open"])
            return F.struct(state.alias("state"), full.alias("full"), now.alias("open"))

        return F.aggregate("_rows", start, step, lambda held: F.flatten(F.concat(held["full"], F.array(held["open"]))))

    folds = {i: v for i, v in slow.items() if isinstance(v, Fold)}
    whole = whole.withColumns({f"_s{i}": states(i, v) for i, v in folds.items()})
    fired = F.filter("_rows", lambda r: r["_mine"].isNotNull())
    out = whole.withColumn("_fired", F.arrays_zip(F.transform(fired, lambda r: r["_mine"]).alias("_mine"), *[f"_s{i}" for i in folds]))
    out = out.select(*group, "_rows", F.explode("_fired").alias("_at"))
    values = {f"_v{i}": F.col(f"_at._s{i}") for i in folds} | {f"_v{i}": F.col(f"_at._mine._v{i}") for i in quick}
    for i, v in slow.items():
        if isinstance(v, Collect):
            values[f"_v{i}"] = F.slice(F.col("_rows").getField(f"_row{i}"), F.lit(1), F.col("_at._mine._rn"))
    return out.select(*group, F.col("_at._mine._pane").alias("_pane"), *[v.alias(k) for k, v in values.items()])
