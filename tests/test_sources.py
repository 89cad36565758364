"""Serdes, directories, bucketed files, keyed partitions, queries against DuckDB."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewater.plans import queries
from tidewater.sources import SERDES, Catalog, Source, bucketed_writer, directory_partitions, rolling_writer, snapshot
from tidewater.sources.catalog import keyed_partition, upsert_sink
from tidewater.sources.serdes import keyed

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("kind", "values", "type"),
    [("int", [0, 1, -1, 2**31 - 1, -(2**31), None], "int"), ("long", [0, -5, 2**63 - 1, -(2**63), None], "long"), ("string", ["é", "", None], "string"), ("double", [0.5, -1e300, 0.0, -0.0, 5e-324, float("inf"), 1 / 3, None], "double"), ("uuid", ["00112233-4455-6677-8899-aabbccddeeff", None], "string")],
)
def test_serdes_round_trip(spark, kind, values, type):
    df = spark.createDataFrame([(v,) for v in values], f"v {type}")
    s = SERDES[kind]
    assert [r.x for r in df.select(s.decode(s.encode(F.col("v"))).alias("x")).collect()] == values


def test_int_bytes_and_keyed(spark):
    assert bytes(spark.range(1).select(SERDES["int"].encode(F.lit(-2)).alias("b")).first().b) == b"\xff\xff\xff\xfe"
    both = keyed(SERDES["int"], SERDES["string"])
    x = F.struct(F.lit(7).alias("key"), F.lit("v").alias("value"))
    assert tuple(spark.range(1).select(both.decode(both.encode(x)).alias("x")).first().x) == (7, "v")


def test_directories(spark, tmp_path):
    path = str(tmp_path / "d")
    for i in range(4):
        spark.range(i + 1).coalesce(1).write.mode("append").csv(f"{path}/part-{i % 2}")
    files = snapshot(spark, path, r".*\.csv", "part-00000-x.*")
    assert len(files) == 4 and files == sorted(files)
    df = directory_partitions(spark.read.csv(files), r"part-(\d)/")
    assert sorted((r.partition, r["count"]) for r in df.groupBy("partition").count().collect()) == [("0", 4), ("1", 6)]
    spark.range(1).coalesce(1).write.mode("append").csv(f"{path}/part-9")
    assert snapshot(spark, path, r".*\.csv", before=files) == files
    os.remove(files[0].replace("file:", ""))
    with pytest.raises(FileNotFoundError):
        snapshot(spark, path, r".*\.csv", before=files)


def test_bucketed_and_rolled_files(spark, tmp_path):
    df = spark.sql("select id, timestamp_ntz '2024-01-02 03:04:05' + make_dt_interval(0, cast(id % 2 as int)) as ts from range(10)")
    bucketed_writer(df, str(tmp_path / "b"), "ts")
    assert sorted(x for x in os.listdir(tmp_path / "b") if x.startswith("bucket")) == ["bucket=2024_01_02-03", "bucket=2024_01_02-04"]
    rolling_writer(df.coalesce(1), str(tmp_path / "r"), max_records=3)
    assert len([x for x in os.listdir(tmp_path / "r") if x.startswith("part")]) == 4


def test_keyed_partition_and_upsert(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), (None, 3, 3)], "__key__ string, v int, __seq__ long")
    assert df.where("__key__ is null").select(keyed_partition("__key__", 8).alias("p")).first().p == 0
    seen = []
    upsert_sink(lambda d, _: seen.extend(sorted((r["__key__"] or "", r.v) for r in d.collect())), "")(df)
    assert seen == [("", 3), ("a", 2)]


def test_catalog_checks_names_and_schemas(spark):
    c = Catalog(spark)
    with pytest.raises(ValueError):
        c.source("one", spark.range(1))
    with pytest.raises(KeyError):
        c.view("a.b")
    with pytest.raises(ValueError):
        Source("a.b", lambda s: s.range(1), schema=spark.createDataFrame([], "id string").schema).frame(spark)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_equal_their_sql(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name not in queries.ORACLE_SQL:
        assert len(got)
        return
    db = duckdb.connect()
    for t in queries.TABLES:
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = db.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)
