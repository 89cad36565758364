"""The SQL front end: refusals, FLATTEN, division, scripts, user-defined functions, sinks."""

import pytest

from tidewater.functions import UdfRegistry
from tidewater.plans import SqlEngine, SqlError, statements
from tidewater.sources import Catalog
from tidewater.sources.catalog import format_sink, json_messages


@pytest.fixture(scope="module")
def engine(spark):
    c = Catalog(spark)
    c.source("src.simple", spark.range(20).selectExpr("cast(id as int) as id", "concat('Name', id) as name", "concat('key', id) as k"), key="k")
    c.source("src.complex", spark.sql("select cast(id as int) as id, transform(sequence(0, id), x -> cast(x as string)) as a from range(20)").selectExpr("id", "slice(a, 1, id) as array_values"))
    c.source("src.arrays", spark.sql("select * from values (1, array('a', 'b')), (2, array()), (3, cast(null as array<string>)) as t(id, a)"))
    udfs = UdfRegistry({"Scale.by": "3"})

    class ScaleUdf:
        def init(self, config):
            self.by = int(config["by"])

        def execute(self, x):
            return None if x is None else str(x * self.by)

    class MyTestArray:
        _tw_udf = None

        def execute(self, n):
            return [str(i) for i in range(n)]

    udfs.add(ScaleUdf)
    from tidewater.functions.udf import udf

    udfs.add(udf("array<string>")(MyTestArray))
    return SqlEngine(spark, c, udfs)


def rows(engine, select):
    return sorted(tuple(r) for r in engine.insert(f"insert into out.x {select}")[1].collect())


@pytest.mark.parametrize(
    "bad",
    [
        "select * from src.simple",
        "insert into select * from src.simple",
        "insert into out.x select from src.simple",
        "insert into out.x select * from src.simple, src.complex",
        "insert into out.x select * from src.simple a join src.complex b on a.id = b.id",
        "insert into out.x select flatten(a), flatten(a) from src.arrays",
        "insert into out.x select flatten(array(id)) from src.simple",
        "insert into out.x select id from src.simple order by id",
        "insert into out select id from src.simple",
        "insert into out.x select (id from src.simple",
    ],
)
def test_refused(engine, bad):
    with pytest.raises((SqlError, ValueError)):
        engine.insert(bad)


def test_flatten_rows(engine):
    assert len(rows(engine, "select flatten(array_values) as v, id from src.complex")) == 190
    assert len(rows(engine, "select flatten(a) as v from (select MyTestArray(id) as a from src.simple)")) == 190


def test_flatten_of_null_and_empty(engine):
    got = engine.insert("insert into out.x select id, flatten(a) as e, a from src.arrays")[1].collect()
    assert sorted((r.id, r.e or "", [x or "" for x in r.a]) for r in got) == [(1, "a", ["a"]), (1, "b", ["b"]), (3, "", [""])]


def test_filter_sees_the_whole_array(engine):
    assert rows(engine, "select id, flatten(a) as e from src.arrays where size(a) = 2") == [(1, "a"), (1, "b")]


def test_integer_division(engine):
    assert rows(engine, "select 7 / 2 as a, -7 / 2 as b, 7.0 / 2 as c, (id + 8) / 3 / 2 as d, '1/2' as e from src.simple where id = 0")[0][:2] == (3, -3)
    got = engine.insert("insert into out.x select 7e0 / 2 as c, (id + 8) / 3 / 2 as d, 1 + 7 / 2 * 2 as f, '1/2' as e from src.simple where id = 0")[1].first()
    assert tuple(got) == (3.5, 1, 7, "1/2")


def test_division_inside_a_call_and_a_filter(engine):
    assert rows(engine, "select abs(-(id / 4)) as x from src.simple where id / 4 = 2") == [(2,)] * 4


def test_key_and_case(engine):
    assert rows(engine, "select `__key__`, id as Id from src.simple where name = 'Name3'") == [("key3", 3)]


def test_udf_has_its_configuration_and_sees_null(engine):
    assert rows(engine, "select Scale(id) as x from src.simple where id = 5") == [("15",)]
    assert rows(engine, "select Scale(nullif(id, 5)) is null as x from src.simple where id = 5") == [(True,)]


def test_scripts():
    text = "-- a comment\ninsert into a.b\n select * from c.d\n\nINSERT INTO e.f select 1 from g.h\n-- end"
    assert statements(text) == ["insert into a.b select * from c.d", "INSERT INTO e.f select 1 from g.h"]
    assert statements('["insert into a.b select 1 from c.d"]') == ["insert into a.b select 1 from c.d"]


def test_execute_writes_to_sinks(spark, engine, tmp_path):
    engine.catalog.sink("out.files", format_sink("parquet", str(tmp_path / "o")))
    engine.catalog.sink("out.json", lambda df: json_messages(df).write.json(str(tmp_path / "j")))
    engine.execute("insert into out.files select id from src.simple where id < 3\ninsert into out.json select __key__, id from src.simple where id < 2")
    assert spark.read.parquet(str(tmp_path / "o")).count() == 3
    assert sorted((r.key, r.value) for r in spark.read.json(str(tmp_path / "j")).collect()) == [("key0", '{"id":0}'), ("key1", '{"id":1}')]


def test_filter_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(10).selectExpr("id", "id * 2 as v", "'x' as unused").write.parquet(path)
    c = Catalog(spark)
    c.source("src.p", lambda s: s.read.parquet(path))
    plan = SqlEngine(spark, c).insert("insert into out.x select v + 1 as w from src.p where id > 3")[1]._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,3)]" in plan and "unused" not in plan.split("ReadSchema")[1]
