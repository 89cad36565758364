"""Options and messages of connectors, Avro schemas, the command line, hopping windows, priorities, dropped messages, salted buckets."""

import datetime as dt
import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, MapType, StringType, StructField, StructType

from tidewater.__main__ import main
from tidewater.operators import Stream, hopping_window
from tidewater.sources import SERDES, avro_type, bucketed_writer, event_hubs_source, index_requests, kafka_messages, kafka_offsets, kafka_source, kinesis_source, matching_topics, readable

T0 = dt.datetime(2024, 1, 1)


def test_offsets():
    got = json.loads(kafka_offsets({"a": 2, "b": 1, "c": 1}, "upcoming", {"b": "oldest"}, {"a": {0: 41}, "c": {0: 7}}, reset={"c"}))
    assert got == {"a": {"0": 42, "1": -1}, "b": {"0": -2}, "c": {"0": -1}}
    with pytest.raises(ValueError):
        kafka_offsets({"a": 1}, "yesterday")


def test_sources():
    assert kafka_source("h:9092", ["a", "b"], start="oldest", batch=10) == {"kafka.bootstrap.servers": "h:9092", "subscribe": "a,b", "startingOffsets": "earliest", "maxOffsetsPerTrigger": "10"}
    assert kafka_source("h:9092", pattern="shop-.*")["subscribePattern"] == "shop-.*"
    for wrong in ({}, {"topics": ["a"], "pattern": "b"}):
        with pytest.raises(ValueError):
            kafka_source("h:9092", **wrong)
    assert matching_topics(["shop-b", "shop-a", "my-shop-a"], "shop-.", serde="json") == {"shop-a": {"serde": "json"}, "shop-b": {"serde": "json"}}
    hub = event_hubs_source("ns", "hub", "secret")
    assert hub["kafka.bootstrap.servers"] == "ns.servicebus.windows.net:9093" and hub["subscribe"] == "hub" and 'password="secret"' in hub["kafka.sasl.jaas.config"]
    assert kinesis_source("eu-west-1", "s", "oldest")["kinesis.startingposition"] == "TRIM_HORIZON"


def test_messages_and_requests(spark):
    df = spark.createDataFrame([(1, "x", 5), (2, None, 5), (3, "y", None)], "id long, v string, u long")
    rows = {r.key: r for r in kafka_messages(df, "t", "id", "u", 8).collect()}
    assert rows["1"].value == '{"v":"x","u":5}' and rows["1"].partition == rows["2"].partition and rows["3"].partition == 0
    got = [tuple(r) for r in index_requests(df, "shop/item", "id", "u").orderBy("id").collect()]
    assert got[0] == ("shop", "item", "1", "5", '{"v":"x","u":5}') and got[2][3] is None
    assert index_requests(df, "shop/item", None).first().id is None
    with pytest.raises(ValueError):
        index_requests(df, "shop")


def test_avro_types():
    schema = {
        "type": "record", "name": "R", "fields": [
            {"name": "i", "type": "int"}, {"name": "n", "type": ["null", "long"]}, {"name": "e", "type": {"type": "enum", "name": "E", "symbols": ["A"]}},
            {"name": "again", "type": "E"}, {"name": "f", "type": {"type": "fixed", "name": "F", "size": 16}}, {"name": "m", "type": {"type": "map", "values": "string"}},
            {"name": "l", "type": {"type": "array", "items": {"type": "record", "name": "In", "fields": [{"name": "x", "type": "string"}]}}},
        ],
    }
    inner = ArrayType(StructType([StructField("x", StringType())]))
    want = [("i", IntegerType()), ("n", LongType()), ("e", StringType()), ("again", StringType()), ("f", BinaryType()), ("m", MapType(StringType(), StringType())), ("l", inner)]
    assert avro_type(json.dumps(schema)) == StructType([StructField(n, t) for n, t in want])
    loop = {"type": "record", "name": "L", "fields": [{"name": "next", "type": ["null", "L"]}]}
    assert avro_type(["int", "null", "string"]) == StringType()
    for wrong in (loop, "date"):
        with pytest.raises(ValueError):
            avro_type(wrong)


def test_command_line(spark, tmp_path, capsys):
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    (tmp_path / "s.sql").write_text("-- double\ninsert into out.d\n select id * 2 as d from src.t\n")
    main(["-f", str(tmp_path / "s.sql"), "--tables", str(tmp_path), "--to", str(tmp_path / "o")])
    assert sorted(r.d for r in spark.read.parquet(str(tmp_path / "o" / "d")).collect()) == [0, 2, 4]
    main(["-s", "insert into out.d select id + 40 as d from src.t where id = 2", "--tables", str(tmp_path)])
    assert "42" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["--tables", str(tmp_path)])


def test_hopping_windows(spark):
    rows = [(i, T0 + dt.timedelta(minutes=7 * i), i % 2) for i in range(30)] + [(99, None, 0)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, k long")
    out = Stream(df, "ts", "id").window(hopping_window(30 * 60_000, 10 * 60_000, "k").agg(n=F.count(F.lit(1)))).df
    want = {}
    for _, ts, k in rows[:-1]:
        for start in range(int((ts - T0).total_seconds()) // 600 - 2, int((ts - T0).total_seconds()) // 600 + 1):
            want[k, start] = want.get((k, start), 0) + 1
    assert {(r.k, int((r.window_start - T0).total_seconds()) // 600): r.n for r in out.collect()} == want
    for wrong in ((10, 20), (10, 0)):
        with pytest.raises(ValueError):
            hopping_window(*wrong)


def test_priorities(spark):
    df = spark.createDataFrame([(1, T0), (2, T0)], "id long, ts timestamp")
    first, then = Stream(df.where("id = 2"), "ts", "id"), Stream(df.where("id = 1"), "ts", "id")
    both = first.merge_by_priority(then)
    assert [(r.id, r.priority) for r in both.df.orderBy("priority").collect()] == [(2, 0), (1, 1)] and both.time == "ts"


def test_unreadable_messages_are_dropped_and_counted(spark):
    df = spark.createDataFrame([(1, bytearray(b"\0\0\0\7")), (2, bytearray(b"no")), (3, None)], "id long, x binary")
    seen = Observation("seen")
    assert sorted(tuple(r) for r in readable(df, "x", SERDES["int"], seen).collect()) == [(1, 7), (3, None)] and seen.get == {"dropped": 1}


def test_a_full_bucket_is_written_by_several_tasks(spark, tmp_path):
    df = spark.range(1000).withColumn("ts", F.lit(T0))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would join tasks as small as these
    try:
        bucketed_writer(df, str(tmp_path / "b"), "ts", tasks=4)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = list((tmp_path / "b" / "bucket=2024_01_01-00").glob("*.parquet"))
    assert 1 < len(files) <= 4 and spark.read.parquet(str(tmp_path / "b")).count() == 1000
