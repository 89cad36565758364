"""Windows, triggers, joins and folds against the known cases and brute-force replays."""

import datetime as dt
import random
import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.operators import Collect, Fold, Stream, any_of, count, count_rows, hopping_window, most_of, repeat, session_window, since_first, since_last, tumbling_window
from tidewater.operators.triggers import firings

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "seq long, ts timestamp_ntz, k int"
few = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def stream(spark, values, seconds=0.001):
    rows = [(i, T0 + dt.timedelta(seconds=seconds * i), k) for i, k in enumerate(values)]
    return Stream(spark.createDataFrame(rows, SCHEMA), "ts", "seq")


def panes(s, spec, trigger=None, mode=None):
    spec = spec.early_trigger(trigger) if trigger else spec
    spec = spec.accumulate(mode) if mode else spec
    return s.window(spec).df


INTS = [40, 70, 40, 70, 40, 70, 40, 70, 95]


def n(*keys):
    return tumbling_window(1000, *keys).agg(n=F.count(F.lit(1)), rows=Collect(("k",)))


def test_keyed_discarding_counts(spark):
    got = panes(stream(spark, INTS), n("k"), repeat(count(2)), "DISCARDING").collect()
    assert sorted(r.n for r in got) == [1, 2, 2, 2, 2] and sorted(len(r.rows) for r in got) == [1, 2, 2, 2, 2]


def test_unkeyed_window(spark):
    got = panes(stream(spark, INTS), n(), repeat(count(1000))).collect()
    assert [(r.n, r.firing_type) for r in got] == [(9, "DEFAULT")]


def test_keyed_accumulating_counts(spark):
    got = panes(stream(spark, INTS), n("k"), repeat(count(2)), "ACCUMULATING").collect()
    assert sorted(r.n for r in got) == [1, 2, 2, 4, 4, 4, 4] and sum(r.firing_type == "EARLY" for r in got) == 4


def test_count_once_gives_one_early_and_one_default(spark):
    got = panes(stream(spark, INTS), n("k"), count(2)).collect()
    assert sorted((r.k, r.firing_type, r.n) for r in got) == [(40, "DEFAULT", 4), (40, "EARLY", 2), (70, "DEFAULT", 4), (70, "EARLY", 2), (95, "DEFAULT", 1)]


def test_sessions_extend_at_the_gap(spark):
    rows = [(0, T0, 1), (1, T0 + dt.timedelta(seconds=5), 1), (2, T0 + dt.timedelta(seconds=10, microseconds=1), 1)]
    s = Stream(spark.createDataFrame(rows, SCHEMA), "ts", "seq")
    assert sorted(r.n for r in s.window(session_window(5000, "k").agg(n=F.count(F.lit(1)))).df.collect()) == [1, 2]


def test_fold_is_in_order(spark):
    fold = Fold(("k",), F.lit(""), lambda old, r: F.concat(old, r["k"].cast("string")))
    got = stream(spark, [3, 1, 2]).window(tumbling_window(1000).agg(s=fold)).df.first()
    assert got.s == "312"


def test_a_window_needs_values_and_a_late_trigger_never_fires(spark):
    with pytest.raises(ValueError):
        stream(spark, INTS).window(tumbling_window(1000))
    with pytest.raises(ValueError):
        n("k").accumulate("SOMETIMES")
    assert panes(stream(spark, INTS), n("k").late_trigger(count(1))).count() == 3


def test_null_keys_and_empty_streams(spark):
    s = stream(spark, [None, None, 1])
    assert sorted(r.n for r in s.window(n("k")).df.collect()) == [1, 2]
    empty = Stream(spark.createDataFrame([], SCHEMA), "ts", "seq")
    assert panes(empty, n("k"), repeat(count(2)), "DISCARDING").count() == 0


def brute(times, spec, end):
    """A replay a millisecond at a time."""
    out, waiting, i = [], {}, 0

    def machine():
        return {"first": None, "last": None, "n": 0, "done": False}

    m = machine()
    parts, again = spec

    def due(now, row):
        for kind, x in parts:
            if row and kind == "count" and m["n"] == x:
                return True
            if not row and kind == "first" and m["first"] is not None and now >= m["first"] + x:
                return True
            if not row and kind == "last" and m["last"] is not None and now >= m["last"] + x:
                return True
        return False

    def fire(rows):
        nonlocal m
        out.append(rows)
        m = machine()
        m["done"] = not again

    for now in range(end):
        if not m["done"] and due(now, False):
            fire(i)
        while i < len(times) and times[i] == now:
            i += 1
            if not m["done"]:
                m["first"] = now if m["first"] is None else m["first"]
                m["last"], m["n"] = now, m["n"] + 1
                if due(now, True):
                    fire(i)
    del waiting
    return out


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.integers(0, 59), max_size=14).map(sorted),
    st.lists(st.tuples(st.sampled_from(["count", "first", "last"]), st.integers(1, 20)), min_size=1, max_size=3),
    st.booleans(),
)
def test_triggers_are_a_replay_by_the_clock(times, parts, again):
    make = {"count": count, "first": since_first, "last": since_last}
    spec = any_of(*[make[k](x) for k, x in parts])
    assert firings(repeat(spec) if again else spec, times, 60) == brute(times, (parts, again), 60)


@few
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 2)), max_size=25), st.sampled_from(["DISCARDING", "ACCUMULATING"]), st.integers(0, 2))
def test_panes_follow_the_firings(spark, rows, mode, which):
    trigger = [repeat(count(3)), since_first(7), repeat(any_of(count(2), since_last(4)))][which]
    data = [(i, T0 + dt.timedelta(milliseconds=t), k) for i, (t, k) in enumerate(sorted(rows))]
    s = Stream(spark.createDataFrame(data, SCHEMA), "ts", "seq")
    got = sorted((r.k, int(r.pane_id), r.seq, r.firing_type, [x.seq for x in r.rows]) for r in panes(s, tumbling_window(20, "k").agg(rows=Collect(("seq",))), trigger, mode).collect())
    want, base = [], int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    groups = {}
    for i, (t, k) in enumerate(sorted(rows)):
        groups.setdefault((k, (base + t) // 20 * 20), []).append((base + t, i))
    for (k, start), g in groups.items():
        fires, low = firings(trigger, [t for t, _ in g], start + 20), 0
        for seq, hi in enumerate([*fires, len(g)]):
            kind = "EARLY" if seq < len(fires) else "DEFAULT"
            ids = [i for _, i in g[low if mode == "DISCARDING" else 0 : hi]]
            if ids:
                want.append((k, start, seq, kind, ids))
            low = hi
    assert got == sorted(want)


@few
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 3), st.integers(0, 30)), max_size=40))
def test_join_is_a_replay(spark, rows):
    data = [(i, T0 + dt.timedelta(seconds=t), k if k else None, side) for i, (side, k, t) in enumerate(rows)]
    df = spark.createDataFrame(data, "seq long, ts timestamp_ntz, k int, side boolean")
    left, right = (Stream(df.where(F.col("side") == x), "ts", "seq") for x in (False, True))
    got = sorted((r.left.seq, r.right.seq, r.by) for r in left.join(right, "k", "10 SECONDS").df.collect())
    want, last = [], {}
    for seq, ts, k, side in sorted(data, key=lambda r: (r[1], r[0])):
        if k is None:
            continue
        last[side, k] = (seq, ts)
        other = last.get((not side, k))
        if other and other[1] > ts - dt.timedelta(seconds=10):
            want.append((other[0], seq, "right") if side else (seq, other[0], "left"))
    assert got == sorted(want)


def test_joining_and_merging_a_stream_with_itself(spark):
    s = stream(spark, INTS)
    with pytest.raises(ValueError):
        s.join(s, "k", "1 SECOND")
    with pytest.raises(ValueError):
        Stream.merge_all([])
    assert s.merge(s).df.count() == 9 and s.merge(stream(spark, INTS)).df.count() == 18


@pytest.mark.parametrize("keys", [(), ("k",)])
@pytest.mark.parametrize("chunk", [1, 2, 4096])
def test_sessions_by_slots_are_the_sessions(spark, monkeypatch, keys, chunk):
    from tidewater.operators import windows

    monkeypatch.setattr(windows, "CHUNK", chunk)
    rng = random.Random(chunk)
    # Before and after the epoch, with rows a gap apart and rows of one time.
    rows = [(i, dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=rng.choice([10, 1]) * rng.randrange(-300, 300)), rng.choice([1, 2, None])) for i in range(120)]
    want = []
    for k in {r[2] for r in rows} if keys else {0}:
        mine = sorted(r[1] for r in rows if not keys or r[2] == k)
        for at, before in zip(mine, [None, *mine], strict=False):
            if before is None or at > before + dt.timedelta(milliseconds=10):
                want.append([at, at, 0])
            want[-1][1:] = at, want[-1][2] + 1
    s = Stream(spark.createDataFrame(rows, SCHEMA), "ts", "seq")
    for values in ({"n": count_rows(), "last": most_of("ts")}, {"n": F.count(F.lit(1)), "last": F.max("ts")}):
        got = s.window(session_window(10, *keys).agg(**values)).df.collect()
        assert sorted([r.window_start, r.last, r.n] for r in got) == sorted(want)
        assert all(r.window_end == r.last + dt.timedelta(milliseconds=10) for r in got)


def test_hops_by_slide_are_the_hops(spark):
    s = stream(spark, INTS * 5, 0.3)
    both = [s.window(hopping_window(ms, 500, "k").agg(n=v)).df.select("k", "window_start", "window_end", "n") for ms in (2000, 500) for v in (count_rows(), F.count(F.lit(1)))]
    for a, b in (both[:2], both[2:]):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_rows_of_sessions_are_not_sorted_and_an_application_shuffles_them_once(spark, tmp_path):
    spark.createDataFrame([(i, T0 + dt.timedelta(seconds=i), i % 3) for i in range(30)], SCHEMA).write.parquet(str(tmp_path / "e"))
    s = Stream(spark.read.parquet(str(tmp_path / "e")), "ts", "seq")
    plan = s.window(session_window(5000, "k").agg(n=count_rows())).df._jdf.queryExecution().executedPlan().toString()
    assert re.split(r"\bExchange\b", plan)[-1].count("Sort") == 0 and "partial_count" in re.split(r"\bExchange\b", plan)[-1]
    keyed = s.partition_by("k", "seq", "ts", "k")
    joined = keyed.filter("seq % 2 = 0").join(keyed.filter("seq % 2 = 1"), "k", "1 HOUR", F.col("key").alias("k"), F.col("matched_at").alias("ts"), F.col("left.seq").alias("seq"))
    out = Stream(joined.df, "ts", "seq").window(session_window(5000, "k").agg(n=count_rows())).df
    assert len(re.findall(r"\bExchange\b", out._jdf.queryExecution().executedPlan().toString())) == 1


def test_accumulating_folds_go_over_a_window_once(spark):
    fold = Fold(("seq",), F.lit(0).cast("long"), lambda old, r: old + r["seq"])

    def took(n):
        df = spark.range(n).select(F.col("id").alias("seq"), (F.lit(T0).cast("timestamp") + F.make_dt_interval(secs=F.col("id") / 1000)).cast("timestamp_ntz").alias("ts"), F.lit(1).alias("k"))
        began = time.monotonic()
        out = Stream(df, "ts", "seq").window(tumbling_window(86_400_000, "k").agg(s=fold).early_trigger(repeat(count(10)))).df
        rows = out.select("seq", "s").collect()
        assert {r.s for r in rows} == {m * (m - 1) // 2 for m in range(10, n + 1, 10)} and len(rows) == n // 10 + 1
        return time.monotonic() - began

    took(1000)
    small, large = took(10_000), took(100_000)
    assert large < 10 * small + 10
