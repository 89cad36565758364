"""Partition choices, reservoirs, time series, and the application of the known case."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewater.operators import Stream, group_tasks, partition_count, partitions_in, partitions_matching, session_window
from tidewater.sources import SERDES
from tidewater.sources.serdes import encrypted
from tidewater.streaming import SlidingReservoir, TaskStore, TimeSeries
from tidewater.streaming.stateful import PlainMap


def test_partition_counts():
    assert partition_count([4, 8], [2]) == 8 and partition_count([999], []) == 256 and partition_count([4], [], configured=5) == 5 and partition_count([], [], [3, 3]) == 3
    with pytest.raises(ValueError):
        partition_count([], [], [3, 4])


def test_partition_matchers_and_groups(spark):
    df = spark.range(12).select(F.col("id").cast("int").alias("partition"), F.lit("s").alias("stream"))
    assert [r.partition for r in df.where(partitions_in("1,3-5,11")).collect()] == [1, 3, 4, 5, 11]
    assert [r.partition for r in df.where(partitions_matching("1.?")).collect()] == [1, 10, 11]
    assert group_tasks(df, "all").rdd.getNumPartitions() == 1 and group_tasks(df, "stream", 3).rdd.getNumPartitions() == 3
    with pytest.raises(ValueError):
        group_tasks(df, "odd")


def test_encrypted_bytes(spark):
    s = encrypted(SERDES["string"], "0123456789abcdef")
    row = spark.range(1).select(s.encode(F.lit("secret")).alias("b")).select("b", s.decode(F.col("b")).alias("x")).first()
    assert row.x == "secret" and b"secret" not in bytes(row.b)


def test_reservoir():
    now = [0.0]
    r = SlidingReservoir(1000, lambda: now[0])
    for v in (5, 1, 3):
        r.update(v)
    assert r.snapshot() == {"count": 3, "min": 1, "max": 5, "avg": 3, "p0.5": 3, "p0.99": 5}
    now[0] = 2.0
    assert r.snapshot() == {"count": 0}


def test_time_series_and_store():
    store = TaskStore(PlainMap({}))
    series = TimeSeries(store)
    for ms, v in ((5, "a"), (5, "b"), (7, "c"), (40, "d")):
        series.put("k", v, ms)
    series.put("k2", "other", 6)
    assert series.get("k", 5, 40) == [(5, "a"), (5, "b"), (7, "c")] and series.get("k", 8, 8) == []
    series.remove("k", 0, 7)
    assert series.get("k", 0, 100) == [(7, "c"), (40, "d")] and series.get("k2", 0, 100) == [(6, "other")]
    with pytest.raises(ValueError):
        store.put(None, "x")
    store.put("z", None)
    assert store.get("z") is None


def test_views_joined_with_clicks_in_sessions(spark):
    """Four views and four clicks joined by view, then sessions of a user: two each."""
    t0 = dt.datetime(2024, 1, 1)
    views = [(i, t0, f"v{i}", p, u) for i, (p, u) in enumerate([("p1", "u1"), ("p2", "u1"), ("p1", "u2"), ("p3", "u2")], 1)]
    clicks = [(i + 10, t0 + dt.timedelta(seconds=1), f"v{i}", f"a{i}") for i in range(1, 5)]
    v = Stream(spark.createDataFrame(views, "id long, ts timestamp_ntz, viewId string, pageId string, userId string"), "ts", "id")
    c = Stream(spark.createDataFrame(clicks, "id long, ts timestamp_ntz, viewId string, adId string"), "ts", "id")
    joined = v.join(c, "viewId", "1 MINUTE", F.col("left.userId").alias("userId"), F.col("matched_at").alias("ts"), F.col("right.id").alias("id"))
    out = Stream(joined.df, "ts", "id").window(session_window(3000, "userId").agg(n=F.count(F.lit(1)))).df
    assert sorted((r.userId, r.n) for r in out.collect()) == [("u1", 2), ("u2", 2)]
