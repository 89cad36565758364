"""Avro containers, sequence files, rolling by bytes and files that grow."""

import datetime as dt
import json
import os
import zlib

import pytest
from pyspark.sql import functions as F

from tidewater.sources import avro
from tidewater.sources.serdes import json as json_serde
from tidewater.sources import readable
from tidewater.streaming import register_sources
from tidewater.streaming.sources import Span, _Lines

KINDS = "id int, ok boolean, x double, y float, s string, b binary, n long, l array<string>, m map<string,long>, r struct<a:int,t:array<struct<z:string>>>, d date, t timestamp"


def rows(n):
    day, moment = dt.date(1969, 12, 30), dt.datetime(1960, 5, 6, 7, 8, 9, 10)
    full = [(i - 2, i % 2 == 0, i / 3, 0.5 * i, f"é{i}" * (i % 5), bytes([i % 256]) * (i % 3), -(2**60) + i, ["a", None, str(i)], {"k": i, "none": None}, (i, [("z",), None]), day + dt.timedelta(i), moment + dt.timedelta(i)) for i in range(n)]
    return [*full, (None,) * 12]


@pytest.mark.parametrize("codec", ["null", "deflate", "bzip2", "xz", "zstandard"])
def test_a_container_comes_back(spark, tmp_path, codec):
    register_sources(spark)
    df = spark.createDataFrame(rows(50), KINDS)
    df.coalesce(1).write.format("tidewater_avro").option("codec", codec).option("blockBytes", 300).mode("append").save(str(tmp_path))
    back = spark.read.format("tidewater_avro").load(str(tmp_path))
    key = F.coalesce("id", F.lit(999))
    assert dict(back.drop("d", "t").dtypes) == dict(df.drop("d", "t").dtypes)
    assert back.drop("d", "t", "m").orderBy(key).collect() == df.drop("d", "t", "m").orderBy(key).collect()
    assert [r.m for r in back.orderBy(key).collect()] == [r.m for r in df.orderBy(key).collect()]
    days, micros = df.select(F.unix_date("d").alias("d"), F.unix_micros("t").alias("t"), key.alias("k")).orderBy("k").select("d", "t").collect(), back.orderBy(key).select("d", "t").collect()
    assert micros == days


def plain(value, out):
    avro.put_long(out, value)


@pytest.mark.parametrize("split", [1, 7, 64, 101, 1 << 20])
def test_each_record_is_read_once_however_a_file_is_cut(tmp_path, split):
    """A container that is put together here, byte by byte."""
    sync, head = bytes(range(16)), bytearray(b"Obj\x01")
    schema = {"type": "record", "name": "R", "fields": [{"name": "n", "type": "long"}, {"name": "u", "type": ["string", "null", "int"]}]}
    plain(2, head)
    for x in (b"avro.schema", json.dumps(schema).encode(), b"avro.codec", b"deflate"):
        plain(len(x), head)
        head += x
    head += b"\x00" + sync
    for k in range(20):
        data = bytearray()
        for i in range(k):
            plain(1000 * k + i - 500, data)
            which = i % 3
            plain(which, data)
            if which == 0:
                data += b"\x04hi"
            elif which == 2:
                plain(-i, data)
        packer = zlib.compressobj(wbits=-15)
        packed = packer.compress(bytes(data)) + packer.flush()
        plain(k, head)
        plain(len(packed), head)
        head += packed + sync
    path = str(tmp_path / "f.avro")
    with open(path, "wb") as out:
        out.write(head)
    found = []
    for part in avro.splits(path, split):
        for header, n, data in avro.blocks(part):
            at, read = 0, avro.decoder(header.schema)
            for _ in range(n):
                row, at = read(data, at)
                found.append((row["n"], row["u"]))
            assert at == len(data)
    assert found == [(1000 * k + i - 500, ["hi", None, str(-i)][i % 3]) for k in range(20) for i in range(k)]
    with open(path, "r+b") as out:
        out.truncate(len(head) - 3)
    with pytest.raises(ValueError):
        [x for part in avro.splits(path) for x in avro.blocks(part)]


def test_a_container_cut_in_four_and_a_newer_schema(spark, tmp_path):
    register_sources(spark)
    df = spark.range(5000).select("id", F.concat(F.lit("x"), "id").alias("s")).coalesce(1)
    df.write.format("tidewater_avro").option("codec", "null").option("blockBytes", 512).mode("append").save(str(tmp_path))
    (name,) = [x for x in os.listdir(tmp_path) if x.endswith(".avro")]
    size = os.path.getsize(tmp_path / name)
    back = spark.read.format("tidewater_avro").option("splitBytes", -(-size // 4)).schema("id long, s string, later int").load(str(tmp_path))
    assert back.rdd.getNumPartitions() == 4
    assert [tuple(r) for r in back.orderBy("id").collect()] == [(i, f"x{i}", None) for i in range(5000)]


@pytest.mark.parametrize("kind", ["tidewater_avro", "tidewater_sequence"])
def test_files_roll_by_bytes_and_records(spark, tmp_path, kind):
    register_sources(spark)
    df = spark.range(2000).select(F.col("id").cast("string").alias("key"), F.concat(F.lit("value "), "id").alias("value")).coalesce(2)
    for option, limit in (("rollBytes", 9000), ("rollRecords", 300)):
        at = str(tmp_path / f"{kind}-{option}")
        df.write.format(kind).option("codec", "null").option("blockBytes", 700).option(option, limit).mode("append").save(at)
        files = [x for x in os.listdir(at) if not x.startswith(".")]
        assert len(files) >= 4 and len(files) == len(os.listdir(at))
        sizes = [os.path.getsize(f"{at}/{x}") for x in files]
        assert max(sizes) <= 9000 if option == "rollBytes" else len(files) == 8
        if kind == "tidewater_avro":
            got = [tuple(r) for r in spark.read.format(kind).load(at).collect()]
        else:
            got = spark.sparkContext.sequenceFile(at).collect()
        assert sorted(got) == sorted((str(i), f"value {i}") for i in range(2000))


def test_sequence_files_of_numbers(spark, tmp_path):
    register_sources(spark)
    want = [(1, 2**40, 1.5, True, bytes(300)), (-7, -5, -0.25, False, b"\x00\xff")]
    df = spark.createDataFrame(want, "i int, l long, d double, t boolean, b binary")
    for key, value in (("i", "l"), ("l", "d"), ("i", "t")):
        at = str(tmp_path / f"{key}{value}")
        df.select(key, value).write.format("tidewater_sequence").mode("append").save(at)
        assert sorted(spark.sparkContext.sequenceFile(at).collect()) == sorted((r[key], r[value]) for r in df.collect())


def test_overwriting_leaves_only_new_files(spark, tmp_path):
    register_sources(spark)
    for n in (5, 3):
        spark.range(n).write.format("tidewater_avro").mode("overwrite").save(str(tmp_path))
    assert spark.read.format("tidewater_avro").load(str(tmp_path)).count() == 3


@pytest.mark.parametrize("split", [1, 3, 8, 1000])
def test_lines_of_spans(tmp_path, split):
    text = b"a\n\nlonger line\r\n" + b"x" * 20 + b"\nlast\nunfinished"
    (tmp_path / "f").write_bytes(text)
    reader = _Lines({"path": str(tmp_path), "splitBytes": str(split)}, "*")
    end = reader.latestOffset()
    assert end == {"f": text.rindex(b"\n") + 1}
    for low in (0, 2, 3):
        found = [(at, line) for span in reader.partitions({"f": low}, end) for _, at, line in reader.read(span)]
        want, at = [], 0
        for line in text.split(b"\n")[:-1]:
            if at >= low:
                want.append((at, line.removesuffix(b"\r").decode()))
            at += len(line) + 1
        assert found == want
    with pytest.raises(ValueError):
        reader.partitions({"f": 10**6}, end)
    assert isinstance(reader.partitions({}, end)[0], Span)


def test_files_that_grow_are_read_on_over_a_restart(spark, tmp_path):
    register_sources(spark)
    top, out = tmp_path / "in", str(tmp_path / "out")
    top.mkdir()

    def go():
        live = spark.readStream.format("tidewater_tail").option("pattern", "*.txt").load(str(top))
        live.writeStream.format("parquet").option("checkpointLocation", out + "-log").trigger(availableNow=True).start(out).awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema("file string, offset long, line string").parquet(out).collect())

    (top / "m.txt").write_text("one\ntwo\nthr")
    (top / "m.other").write_text("no\n")
    assert go() == [("m.txt", 0, "one"), ("m.txt", 4, "two")]
    with open(top / "m.txt", "a") as f:
        f.write("ee\nfour\n")
    (top / "a.txt").write_text("first by name\n")  # moves no other
    assert go() == [("a.txt", 0, "first by name"), ("m.txt", 0, "one"), ("m.txt", 4, "two"), ("m.txt", 8, "three"), ("m.txt", 14, "four")]


def test_messages_that_are_no_json_are_dropped(spark):
    texts = ['{"a": 1}', "nonsense", '{"a" broken', "", None, '{"b": 2}', '{"a": "no number"}', "[1]"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, j string").withColumn("j", F.col("j").cast("binary"))
    got = {r.id: r.j for r in readable(df, "j", json_serde("a int")).collect()}
    assert {k: v and v.a for k, v in got.items()} == {0: 1, 4: None, 5: None}
