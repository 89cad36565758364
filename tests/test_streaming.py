"""Keyed state against the bounded operators, end of stream, restart, tasks and the log source."""

import datetime as dt
import json
import threading
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.operators import Stream, count, repeat, tumbling_window
from tidewater.streaming import Task, async_batches, join_streams, read_state, register_sources, replay, run_task, to_event_time, window_stream

ROWS = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=37 * i), i % 3, "view" if i % 2 else "click", float(i % 7)) for i in range(60)]
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


@pytest.fixture
def events(spark, tmp_path):
    """The rows in four files, in order of time."""
    for k in range(4):
        spark.createDataFrame(ROWS[15 * k : 15 * k + 15], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def run(df, tmp_path, name):
    out = str(tmp_path / f"{name}-out")
    df.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-ck")).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def test_join_of_streams_is_the_bounded_join(spark, events, tmp_path):
    parts = [replay(spark, events, SCHEMA, 100).where(F.col("event_type") == x) for x in ("view", "click")]
    found = run(join_streams(*parts, "user_id", "ts", "event_id", 120_000), tmp_path, "join").collect()
    got = {(r.key, json.loads(r.left)["event_id"], json.loads(r.right)["event_id"]) for r in found}
    e = Stream(spark.createDataFrame(ROWS, SCHEMA), "ts", "event_id")
    joined = e.filter("event_type = 'view'").join(e.filter("event_type = 'click'"), "user_id", "120 SECONDS").df
    assert got == {(r.key, r.left.event_id, r.right.event_id) for r in joined.collect()} and got


def test_windows_of_a_stream_are_the_bounded_panes(spark, events, tmp_path):
    stream = to_event_time(replay(spark, events, SCHEMA, 100), "ts", "0 seconds")
    last = (99, dt.datetime(2030, 1, 1), 99, "end", 0.0)
    spark.createDataFrame([last], SCHEMA).coalesce(1).write.mode("append").parquet(events)
    found = run(window_stream(stream, "tumbling", 300_000, "user_id", "ts", "event_id", "value", repeat(count(2)), "DISCARDING"), tmp_path, "win").where("key <> 99")
    spec = tumbling_window(300_000, "user_id").agg(n=F.count(F.lit(1)), total=F.sum("value")).early_trigger(repeat(count(2))).accumulate("DISCARDING")
    bounded = Stream(spark.createDataFrame(ROWS, SCHEMA), "ts", "event_id").window(spec).df
    columns = ["user_id", "pane_id", "seq", "firing_type", "n", "total"]
    got = sorted(tuple(r) for r in found.toDF(*columns).collect())
    assert got == sorted(tuple(r) for r in bounded.select(columns).collect())


def summing():
    class Sum(Task):
        def process(self, key, row, store):
            total = int(store.get("sum") or 0) + row.event_id
            store.put("sum", str(total))
            store.put_all({"a": "1", "b": "2"})
            store.delete("b")
            assert store.range("a", "b") == [("a", "1")] and store.get_all(["a", "b"]) == {"a": "1", "b": None}
            return [(key, total)]

    return Sum()


def test_a_task_keeps_its_state_over_a_restart(spark, events, tmp_path):
    def go():
        return run(run_task(replay(spark, events, SCHEMA, 100), "user_id", summing(), "user_id long, total long"), tmp_path, "task")

    go()
    spark.createDataFrame([(1000, ROWS[0][1], 0, "view", 1.0)], SCHEMA).coalesce(1).write.mode("append").parquet(events)
    top = go().groupBy("user_id").agg(F.max("total").alias("t"))
    want = {u: sum(r[0] for r in ROWS if r[2] == u) + (1000 if u == 0 else 0) for u in range(3)}
    assert {r.user_id: r.t for r in top.collect()} == want


def test_the_log_source_resumes_where_its_checkpoint_says(spark, tmp_path):
    register_sources(spark)
    log = str(tmp_path / "log")
    spark.createDataFrame([("a", "1"), (None, "2")], "key string, value string").coalesce(1).write.format("tidewater_log").mode("append").save(log)
    read = spark.readStream.format("tidewater_log").load(log)
    assert run(read, tmp_path, "log").count() == 2
    spark.createDataFrame([("c", "3")], "key string, value string").coalesce(1).write.format("tidewater_log").mode("append").save(log)
    assert sorted(r.value for r in run(read, tmp_path, "log").collect()) == ["1", "2", "3"]


def test_async_batches_drop_none(spark):
    def call(row):
        return None if row["id"] % 2 else {"id": row["id"], "twice": 2 * row["id"]}

    got = Stream(spark.range(6)).map_batches(async_batches(call, 4, 10), "id long, twice long").df
    assert sorted(tuple(r) for r in got.collect()) == [(0, 0), (2, 4), (4, 8)]


def test_calls_are_bounded_in_order_and_made_again():
    now, most, tries, lock = [0], [0], {}, threading.Lock()

    def call(row):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
            tries[row["id"]] = tries.get(row["id"], 0) + 1
        time.sleep(0.02 if row["id"] % 3 else 0.06)
        with lock:
            now[0] -= 1
        if row["id"] == 7 and tries[7] == 1:
            raise OSError("busy")
        return {"id": row["id"]}

    read = []

    def source():
        for k in range(4):
            read.append(k)
            yield pd.DataFrame({"id": range(10 * k, 10 * k + 10)})

    got = [i for pdf in async_batches(call, 3, retries=1, batch=5)(source()) for i in pdf["id"]]
    assert got == list(range(40)) and most[0] == 3 and tries[7] == 2 and max(tries.values()) == 2
    with pytest.raises(TimeoutError):
        list(async_batches(lambda row: time.sleep(1), 2, timeout_s=0.05)(iter([pd.DataFrame({"id": [1]})])))
    with pytest.raises(OSError):
        list(async_batches(lambda row: (_ for _ in ()).throw(OSError("down")), 2, retries=2)(iter([pd.DataFrame({"id": [1]})])))


def reminding():
    class Remind(Task):
        def process(self, key, row, store):
            store.put(str(row.event_id), str(row.value))
            store.remind(60_000 * (1 + int(row.ts.timestamp()) // 60))
            return []

        def watermark(self, key, ms, store):
            return [(key, ms, len(store.all()))]

    return Remind()


def test_a_watermark_function_emits_when_time_passes(spark, events, tmp_path):
    stream = to_event_time(replay(spark, events, SCHEMA, 100), "ts", "0 seconds")
    spark.createDataFrame([(99, dt.datetime(2030, 1, 1), 99, "end", 0.0)], SCHEMA).coalesce(1).write.mode("append").parquet(events)
    rows = run(run_task(stream, "user_id", reminding(), "user_id long, ms long, n int", event_time=True), tmp_path, "wm").where("user_id < 3").collect()
    assert {r.user_id for r in rows} == {0, 1, 2} and all(r.n == 20 for r in rows)
    seen = {(r.user_id, r.ms) for r in rows}
    assert len(seen) == len(rows)


def test_state_of_a_join_leaves_by_event_time(spark, events, tmp_path):
    """A late last row of other keys moves the watermark past all others, whose state then goes; the query ends."""
    last = [(100 + k, dt.datetime(2030, 1, 1), 99, x, 0.0) for k, x in enumerate(("view", "click"))]
    spark.createDataFrame(last, SCHEMA).coalesce(1).write.mode("append").parquet(events)
    for delay in ("0 seconds", None):
        parts = [replay(spark, events, SCHEMA, 100).where(F.col("event_type") == x) for x in ("view", "click")]
        found = run(join_streams(*parts, "user_id", "ts", "event_id", 120_000, delay), tmp_path, "evict" if delay else "stays")
        assert found.where("key <> 99").count() > 0
        held = {r.key.key for side in ("side0", "side1") for r in read_state(spark, str(tmp_path / ("evict-ck" if delay else "stays-ck")), side).collect()}
        assert held == ({99} if delay else {0, 1, 2, 99})
