"""Windows of a stream whose rows come out of order over micro-batches, on a state held in memory."""

import itertools
import random

import pandas as pd
import pytest

from tidewater.operators import any_of, count, repeat, since_first, since_last
from tidewater.streaming import OrderedMap, TaskStore, TimeSeries, TriggeredWindows, values
from tidewater.streaming.windows import Spec


class Map:
    def __init__(self):
        self.rows, self.reads, self.writes = {}, 0, 0

    def iterator(self):
        return iter(list(self.rows.items()))

    def containsKey(self, key):  # noqa: N802
        return key in self.rows

    def getValue(self, key):  # noqa: N802
        self.reads += 1
        return self.rows[key]

    def updateValue(self, key, value):  # noqa: N802
        self.writes += 1
        self.rows[key] = value

    def removeKey(self, key):  # noqa: N802
        self.rows.pop(key, None)


class One:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Handle:
    def __init__(self):
        self.map, self.one, self.timers = Map(), One(), []

    def getMapState(self, *_):  # noqa: N802
        return self.map

    def getValueState(self, *_):  # noqa: N802
        return self.one

    def registerTimer(self, ms):  # noqa: N802
        self.timers.append(ms)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


WANTED = {"n": values.number(), "total": values.total("value"), "all": values.rows("value", "double")}


def replay(spec, batches, handle=None):
    """Early panes of the batches of (ms, value), then what the timers give."""
    windows, handle = TriggeredWindows(spec, ["tw_ms", "tw_tie", "value"]), handle or Handle()
    windows.init(handle)
    out, tie = [], 0
    for batch in batches:
        rows = pd.DataFrame([(ms, tie + i, float(v)) for i, (ms, v) in enumerate(batch)], columns=["tw_ms", "tw_tie", "value"])
        tie += len(batch)
        out += [tuple(r) for pdf in windows.handleInputRows((1,), iter([rows]), None) for r in pdf.drop(columns="key").itertuples(index=False)]
    seen = set()
    while todo := sorted(set(handle.timers) - seen):
        seen.add(todo[0])
        out += [tuple(r) for pdf in windows.handleExpiredTimer((1,), Clock(todo[0]), None) for r in pdf.drop(columns="key").itertuples(index=False)]
    assert not handle.map.rows
    return out


@pytest.mark.parametrize("times", list(itertools.permutations([100, 108, 116, 140])) + [(108, 100)])
def test_sessions_merge(times):
    out = [(r[0], r[3], r[4]) for r in replay(Spec("session", 10, WANTED), [[(t, t)] for t in times])]
    assert out == ([("100", 2, 208.0)] if len(times) == 2 else [("100", 3, 324.0), ("140", 1, 140.0)])


def test_each_row_is_in_one_discarding_pane():
    spec = Spec("tumbling", 1000, WANTED, repeat(count(2)), "DISCARDING")
    out = replay(spec, [[(100, 1), (300, 10)], [(50, 100), (400, 1000)]])
    assert out == [("0", 0, "EARLY", 2, 11.0, [1.0, 10.0]), ("0", 1, "EARLY", 2, 1100.0, [100.0, 1000.0])]


def test_accumulating_panes_hold_all_rows_so_far():
    out = replay(Spec("tumbling", 1000, WANTED, repeat(count(2))), [[(100, 1), (300, 10)], [(50, 100)]])
    assert out == [("0", 0, "EARLY", 2, 11.0, [1.0, 10.0]), ("0", 1, "DEFAULT", 3, 111.0, [100.0, 1.0, 10.0])]


def test_sessions_that_join_keep_their_rows():
    spec = Spec("session", 10, WANTED, repeat(count(2)), "DISCARDING")
    out = replay(spec, [[(100, 1), (120, 5)], [(110, 1000)]])
    # The joining row is the third of one session: both waited for a second row.
    assert sum(r[3] for r in out) == 3 and sum(r[4] for r in out) == 1006.0
    assert [r[2] for r in out] == ["EARLY"] and {r[0] for r in out} == {"100"}


TRIGGERS = [repeat(count(3)), since_first(40), repeat(since_last(15)), repeat(any_of(count(4), since_first(60), since_last(20))), any_of(count(2), since_first(5))]


@pytest.mark.parametrize("trigger", TRIGGERS)
@pytest.mark.parametrize("kind", ["tumbling", "session"])
@pytest.mark.parametrize("seed", range(4))
def test_rows_out_of_order_are_in_one_pane_each(trigger, kind, seed):
    rng = random.Random(seed)
    batches = [[(rng.randrange(0, 600), 2.0 ** (6 * b + i)) for i in range(rng.randrange(1, 6))] for b in range(7)]
    out = replay(Spec(kind, 100 if kind == "tumbling" else 12, WANTED, trigger, "DISCARDING"), batches)
    assert sorted(v for r in out for v in r[5]) == sorted(v for b in batches for _, v in b)
    assert len({(r[0], r[1]) for r in out}) == len(out) and all(r[3] == len(r[5]) for r in out)


def test_state_of_numbers_does_not_grow():
    sizes, handle = [], Handle()
    windows = TriggeredWindows(Spec("tumbling", 1 << 40, {"n": values.number(), "mean": values.mean("value"), "top": values.most("value")}, repeat(count(7))), ["tw_ms", "tw_tie", "value"])
    windows.init(handle)
    for k in range(50):
        list(windows.handleInputRows((1,), iter([pd.DataFrame({"tw_ms": range(20), "tw_tie": range(20), "value": [float(k)] * 20})]), None))
        sizes.append(sum(len(v[4]) for v in handle.map.rows.values()))
    assert max(sizes) < sizes[0] + 20


def test_a_time_series_touches_the_buckets_of_its_times():
    handle = Handle()
    entries = OrderedMap(handle)
    series = TimeSeries(TaskStore(entries, handle))
    for i in range(100_000):
        series.put("k", str(i), 10 * i)
    entries.flush()
    assert max(len(k) for k, _ in handle.map.rows.values()) <= 512 and len(handle.map.rows) > 100
    for act, reads in ((lambda: series.put("k", "x", 500_005), 1), (lambda: series.get("k", 400_000, 400_100), 2), (lambda: series.get("k", 0, 5), 1), (lambda: series.remove("k", 999_980, 999_990), 2)):
        entries.begin()
        handle.map.reads = handle.map.writes = 0
        act()
        entries.flush()
        assert handle.map.reads <= reads and handle.map.writes <= 2
    entries.begin()
    assert series.get("k", 500_000, 500_010) == [(500_000, "50000"), (500_005, "x")] and series.get("k", 999_980, 10**9) == [(999_990, "99999")]


@pytest.mark.parametrize("seed", range(3))
def test_the_ordered_map_is_a_dictionary(seed):
    rng, handle, held = random.Random(seed), Handle(), {}
    entries = OrderedMap(handle)
    for step in range(6000):
        key = rng.randbytes(rng.randrange(1, 3))
        what = rng.random()
        if what < 0.6:
            value = rng.randbytes(3)
            entries.put(key, value)
            held[key] = value
        elif what < 0.8:
            entries.remove(key)
            held.pop(key, None)
        elif what < 0.82:
            stop = bytes([min(255, key[0] + rng.randrange(3))])
            entries.remove_range(key, stop)
            held = {k: v for k, v in held.items() if not key <= k < stop}
        else:
            stop = rng.choice([None, rng.randbytes(1)])
            assert list(entries.range(key, stop)) == sorted((k, v) for k, v in held.items() if k >= key and (stop is None or k < stop))
        assert entries.get(key) == held.get(key)
        if step % 50 == 0:
            entries.flush()
            entries.begin()
    entries.flush()
    entries.begin()
    assert dict(entries.range()) == held
    entries.remove_range(b"", None)
    entries.flush()
    assert not handle.map.rows and handle.one.value is None
