"""The library's queries over the test tables, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import UdfRegistry, regex_match, udf
from ..operators import Collect, Fold, Stream, any_of, count, count_rows, group_tasks, hopping_window, least_of, most_of, partitions_in, partitions_matching, repeat, session_window, since_first, since_last, tumbling_window
from ..session import scratch
from ..sources import SERDES, bucketed_writer, directory_partitions, index_requests, kafka_messages, readable, rolling_writer, snapshot
from ..sources.serdes import json
from ..sources.catalog import Catalog, json_messages, keyed_partition, parquet_sink, upsert_sink
from ..streaming import SHUTDOWN, Task, TimeSeries, async_batches, close_windows, end_task, join_streams, register_sources, run_task, run_until_shutdown, to_event_time, values, window_stream
from .sqlfront import SqlEngine

HOUR, MINUTE = 3_600_000, 60_000
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
_KEYS = {"events": "event_id", "orders": "o_orderkey", "part": "p_partkey"}


@udf("string", name="RegexExtractFirst", vectorized=True)
class RegexExtractFirstUdf:
    """A user-defined function with a configuration: the first match of its pattern."""

    def init(self, config: dict[str, str]) -> None:
        self.pattern = f"({config['pattern']})"

    def execute(self, text):
        return text.str.extract(self.pattern, expand=False)


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """Every test table as ``src.<table>``."""
    found = Catalog(spark)
    for name in TABLES:
        found.source(f"src.{name}", lambda s, name=name: s.read.parquet(f"{sf_dir}/{name}.parquet"), key=_KEYS.get(name))
    return found


def sql(name: str, statement: str, oracle: str, extended: bool = False) -> None:
    """A query that is one statement of the SQL front end."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        registry = UdfRegistry({"RegexExtractFirst.pattern": "[aeiou]+"})
        registry.add(RegexExtractFirstUdf)
        return SqlEngine(spark, catalog(spark, sf_dir), registry, extended=extended).insert(f"INSERT INTO out.{name} {statement}")[1]

    QUERIES[name], ORACLE_SQL[name] = run, oracle


def stream(name: str, oracle: str | None) -> Callable[[Callable[[Stream], DataFrame]], Callable]:
    """A query over ``events`` as a stream."""

    def mark(fn: Callable[[Stream], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: fn(events(spark, sf_dir))
        if oracle:
            ORACLE_SQL[name] = oracle
        return fn

    return mark


def events(spark: SparkSession, sf_dir: str) -> Stream:
    return Stream(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "event_id")


# SQL front end

sql(
    "sql_project_filter",
    "SELECT user_id, value * 2 AS v2 FROM src.events WHERE event_type = 'click'",
    "select user_id, value * 2 as v2 from events where event_type = 'click'",
)
sql(
    "sql_key_column",
    "SELECT __key__, event_type FROM src.events WHERE user_id IN (1, 2, 3) AND event_type NOT IN ('view')",
    "select cast(event_id as varchar) as __key__, event_type from events where user_id in (1, 2, 3) and event_type not in ('view')",
)
sql(
    "sql_is_predicates",
    """SELECT event_id, (value > 50) IS TRUE AS a, (value > 50) IS NOT TRUE AS b, (value > 50) IS FALSE AS c, (value > 50) IS NOT FALSE AS d,
       props IS NULL AS e, props IS NOT NULL AS f, NOT (user_id = 7) AS g, user_id <> 7 OR value <= 10 AS h FROM src.events WHERE user_id >= 5 AND user_id < 60""",
    """select event_id, coalesce(value > 50, false) as a, not coalesce(value > 50, false) as b, coalesce(not (value > 50), false) as c, not coalesce(not (value > 50), false) as d,
       props is null as e, props is not null as f, not (user_id = 7) as g, user_id <> 7 or value <= 10 as h from events where user_id >= 5 and user_id < 60""",
)
sql(
    "sql_strings",
    """SELECT p_partkey, p_name || '-' || p_brand AS joined, CHAR_LENGTH(p_name) AS n, SUBSTRING(p_name FROM 2 FOR 5) AS part, REPLACE(p_type, 'A', 'aa') AS replaced,
       TRIM(BOTH 'B' FROM p_brand) AS t1, TRIM(LEADING 'B' FROM p_brand) AS t2, TRIM(TRAILING '3' FROM p_brand) AS t3, UPPER(p_name) AS u, LOWER(p_type) AS l FROM src.part""",
    """select p_partkey, p_name || '-' || p_brand as joined, cast(length(p_name) as integer) as n, substring(p_name, 2, 5) as part, replace(p_type, 'A', 'aa') as replaced,
       trim(p_brand, 'B') as t1, ltrim(p_brand, 'B') as t2, rtrim(p_brand, '3') as t3, upper(p_name) as u, lower(p_type) as l from part""",
)
sql(
    "sql_math",
    """SELECT l_orderkey, l_linenumber, l_orderkey / 7 AS whole, (l_partkey + 3) / 2 / 3 AS chain, l_quantity / 4 AS part, MOD(l_orderkey, 13) AS m, POWER(l_linenumber, 2) AS p, SQRT(l_quantity) AS s,
       FLOOR(l_extendedprice) AS f, CEIL(l_extendedprice) AS c, -l_suppkey AS neg, +l_suppkey AS pos, l_quantity - 1 AS minus, l_quantity * 3 + 1 AS times FROM src.lineitem""",
    """select l_orderkey, l_linenumber, l_orderkey // 7 as whole, (l_partkey + 3) // 2 // 3 as chain, l_quantity / 4 as part, l_orderkey % 13 as m, cast(l_linenumber * l_linenumber as double) as p, sqrt(l_quantity) as s,
       cast(floor(l_extendedprice) as bigint) as f, cast(ceil(l_extendedprice) as bigint) as c, -l_suppkey as neg, l_suppkey as pos, l_quantity - 1 as minus, l_quantity * 3 + 1 as times from lineitem""",
)
sql(
    "sql_dates",
    """SELECT o_orderkey, MONTH(o_orderdate) AS m, TIMESTAMPADD(DAY, 3, o_orderdate) AS later, TIMESTAMPDIFF(DAY, TIMESTAMP_NTZ '1990-01-01 00:00:00', o_orderdate) AS days,
       CAST(o_totalprice AS BIGINT) AS whole, CAST(o_orderkey AS STRING) AS s, date_trunc('MONTH', o_orderdate) AS month FROM src.orders""",
    """select o_orderkey, cast(month(o_orderdate) as integer) as m, o_orderdate + interval 3 day as later, cast(date_diff('day', timestamp '1990-01-01', o_orderdate) as bigint) as days,
       cast(trunc(o_totalprice) as bigint) as whole, cast(o_orderkey as varchar) as s, date_trunc('month', o_orderdate) as month from orders""",
)
sql(
    "sql_clock",
    "SELECT event_id, CURRENT_DATE IS NOT NULL AS a, CURRENT_TIMESTAMP IS NOT NULL AS b, LOCALTIMESTAMP IS NOT NULL AS c, CURRENT_TIME IS NOT NULL AS d, LOCALTIME IS NOT NULL AS e FROM src.events",
    "select event_id, true as a, true as b, true as c, true as d, true as e from events",
)
sql("sql_flatten", "SELECT vec_id, FLATTEN(embedding) AS x FROM src.embeddings", "select vec_id, unnest(embedding) as x from embeddings")
sql(
    "sql_flatten_sub_select",
    "SELECT FLATTEN(words) AS word, p_partkey FROM (SELECT split(p_name, ' ') AS words, p_partkey FROM src.part WHERE p_size > 10)",
    "select unnest(string_split(p_name, ' ')) as word, p_partkey from part where p_size > 10",
)
sql(
    "sql_sub_select",
    "SELECT v + 1 AS v, user_id FROM (SELECT value * 2 AS v, user_id FROM (SELECT value, user_id FROM src.events WHERE value > 10) AS a WHERE user_id > 20) AS b WHERE v < 100",
    "select v + 1 as v, user_id from (select value * 2 as v, user_id from events where value > 10 and user_id > 20) where v < 100",
)
sql(
    "sql_udf",
    "SELECT event_id, RegexExtractFirst(event_type) AS vowels FROM src.events",
    "select event_id, nullif(regexp_extract(event_type, '[aeiou]+'), '') as vowels from events",
)
sql(
    "sql_tumble_sum",
    "SELECT TUMBLE_START(ts, INTERVAL '1' HOUR) AS s, TUMBLE_END(ts, INTERVAL '1' HOUR) AS e, COUNT(*) AS n, SUM(user_id) AS total, SUM0(user_id) AS total0 FROM src.events GROUP BY TUMBLE(ts, INTERVAL '1' HOUR)",
    """select time_bucket(interval 1 hour, ts) as s, time_bucket(interval 1 hour, ts) + interval 1 hour as e, count(*) as n, cast(sum(user_id) as bigint) as total, cast(sum(user_id) as bigint) as total0
       from events group by time_bucket(interval 1 hour, ts)""",
)
sql(
    "sql_extended_join_top",
    "SELECT c.c_mktsegment AS segment, COUNT(*) AS n FROM src.orders AS o JOIN src.customer AS c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'F' GROUP BY c.c_mktsegment HAVING COUNT(*) > 1 ORDER BY 1 LIMIT 3",
    "select c_mktsegment as segment, count(*) as n from orders join customer on o_custkey = c_custkey where o_orderstatus = 'F' group by 1 having count(*) > 1 order by 1 limit 3",
    extended=True,
)

sql(
    "sql_union",
    "SELECT event_id, user_id FROM src.events WHERE event_type = 'view' UNION ALL SELECT event_id, user_id FROM src.events WHERE value > 50 UNION ALL SELECT c_custkey, c_nationkey FROM src.customer",
    "select event_id, user_id from events where event_type = 'view' union all select event_id, user_id from events where value > 50 union all select c_custkey, c_nationkey from customer",
    extended=True,
)
sql(
    "sql_intersect_except",
    "SELECT user_id FROM (SELECT user_id FROM src.events WHERE event_type = 'view' INTERSECT SELECT user_id FROM src.events WHERE event_type = 'click') AS t WHERE user_id > 1 EXCEPT SELECT c_custkey FROM src.customer WHERE c_custkey < 5",
    "(select user_id from events where event_type = 'view' intersect select user_id from events where event_type = 'click') except select c_custkey from customer where c_custkey < 5 or c_custkey <= 1",
    extended=True,
)
sql("sql_unnest", "SELECT e.vec_id AS vec_id, x FROM src.embeddings AS e, UNNEST(e.embedding) AS t(x) WHERE x > 0.1", "select vec_id, x from (select vec_id, unnest(embedding) as x from embeddings) where x > cast(0.1 as decimal(2,1))", extended=True)
sql(
    "sql_left_join",
    "SELECT c.c_custkey AS c_custkey, COUNT(o.o_orderkey) AS n, COUNT(DISTINCT o.o_orderstatus) AS kinds FROM src.customer AS c LEFT JOIN src.orders AS o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey",
    "select c_custkey, count(o_orderkey) as n, count(distinct o_orderstatus) as kinds from customer left join orders on o_custkey = c_custkey group by 1",
    extended=True,
)
sql(
    "sql_dot",
    "SELECT event_id, s.a AS a, s.b AS b FROM (SELECT event_id, named_struct('a', user_id, 'b', value) AS s FROM src.events) AS t WHERE s.a > 10",
    "select event_id, user_id as a, value as b from events where user_id > 10",
)
sql(
    "sql_floor_ceil_to",
    "SELECT event_id, FLOOR(ts TO DAY) AS d, CEIL(ts TO HOUR) AS h, FLOOR(ts TO MONTH) AS m, CEIL(FLOOR(ts TO DAY) TO DAY) AS same, FLOOR(value) AS v FROM src.events",
    """select event_id, date_trunc('day', ts) as d, case when date_trunc('hour', ts) = ts then ts else date_trunc('hour', ts) + interval 1 hour end as h,
       date_trunc('month', ts) as m, date_trunc('day', ts) as same, cast(floor(value) as bigint) as v from events""",
)
sql(
    "sql_units_and_varchar",
    "SELECT event_id, TIMESTAMPADD(SQL_TSI_DAY, 2, ts) AS later, TIMESTAMPDIFF(SQL_TSI_HOUR, TIMESTAMP_NTZ '2020-01-01 00:00:00', ts) AS hours, CAST(user_id AS VARCHAR) AS s FROM src.events",
    "select event_id, ts + interval 2 day as later, cast(trunc(epoch_us(ts) - epoch_us(timestamp '2020-01-01')) // 3600000000 as bigint) as hours, cast(user_id as varchar) as s from events",
)
sql(
    "sql_clocks_agree",
    """SELECT event_id, CURRENT_DATE = CAST(CURRENT_TIMESTAMP AS DATE) AS a, CAST(LOCALTIMESTAMP AS DATE) = CURRENT_DATE AS b, LOCALTIMESTAMP > TIMESTAMP_NTZ '2024-01-01 00:00:00' AS c,
       LOCALTIME = CURRENT_TIME AS d FROM src.events""",
    "select event_id, true as a, true as b, true as c, true as d from events",
)


# row transforms and exchange


@stream("stream_map_filter", "select event_id, value + 1 as v from events where event_type = 'view' and value > 5")
def _map(e: Stream) -> DataFrame:
    big = F.when(F.col("value") > 5, F.col("value") + 1)
    return e.filter("event_type = 'view'").map("event_id", big.alias("v"), drop_null="v").df


@stream("stream_flat_map", "select event_id, unnest(string_split(event_type, 'i')) as part from events")
def _flat_map(e: Stream) -> DataFrame:
    return e.flat_map(F.split("event_type", "i"), "part", ["event_id"]).df


@stream("stream_flatten_nulls", "select event_id, case when user_id % 3 = 2 then null else event_type end as items from events where user_id % 3 <> 0")
def _flatten(e: Stream) -> DataFrame:
    third = F.col("user_id") % 3
    items = F.when(third == 0, F.array().cast("array<string>")).when(third == 1, F.array("event_type"))
    return e.map("event_id", items.alias("items")).flatten("items").df


@stream("stream_regex_match", "select event_id from events where regexp_full_match(event_type, 'c.*k')")
def _regex(e: Stream) -> DataFrame:
    return e.filter(regex_match("c.*k", F.col("event_type"))).map("event_id").df


@stream("stream_map_batches", "select event_id, length(event_type) + user_id as n from events")
def _batches(e: Stream) -> DataFrame:
    def run(batches):
        for pdf in batches:
            yield pdf[["event_id"]].assign(n=pdf["event_type"].str.len() + pdf["user_id"])

    return e.map_batches(run, "event_id long, n long").df


@stream("stream_partition_by", "select cast(user_id as varchar) as __key__, event_id, value from events")
def _partition(e: Stream) -> DataFrame:
    return e.partition_by(F.col("user_id").cast("string"), "event_id", "value", partitions=8).df


@stream("stream_null_keys_to_one_partition", "select cast(count(*) as bigint) as n, true as together from events where user_id % 5 = 0")
def _null_keys(e: Stream) -> DataFrame:
    key = F.when(F.col("user_id") % 5 != 0, F.col("user_id"))
    return e.map("event_id", key.alias("k")).df.withColumn("p", keyed_partition("k", 8)).where("k is null").agg(F.count(F.lit(1)).alias("n"), (F.max("p") == 0).alias("together"))


@stream("stream_merge", "select event_id, event_type from events where event_type = 'view' union all select event_id, event_type from events where value > 50")
def _merge(e: Stream) -> DataFrame:
    views = e.filter("event_type = 'view'").map("event_id", "event_type")
    return Stream.merge_all([views, e.filter("value > 50").map("event_id", "event_type"), views]).df


@stream("stream_json_messages", """select cast(event_id as varchar) as key, '{"user_id":' || user_id || ',"event_type":"' || event_type || '"}' as value from events""")
def _messages(e: Stream) -> DataFrame:
    return json_messages(e.map(F.col("event_id").cast("string").alias("__key__"), "user_id", "event_type").df)


# joins

_TTL = """
with u as (select user_id as k, ts, event_id as id, case when event_type = 'view' then 0 else 1 end as side from events where event_type in ('view', 'click')),
l as (select *, last_value(case when side = 0 then id end ignore nulls) over w as lid, last_value(case when side = 0 then ts end ignore nulls) over w as lts,
             last_value(case when side = 1 then id end ignore nulls) over w as rid, last_value(case when side = 1 then ts end ignore nulls) over w as rts
      from u window w as (partition by k order by ts, id, side rows between unbounded preceding and 1 preceding)),
j as (select k, case when side = 0 then id else lid end as view_id, case when side = 1 then id else rid end as click_id, ts as matched_at, case when side = 0 then 'left' else 'right' end as side_in
      from l where case when side = 0 then rts else lts end > ts - interval 12 hour)
"""


def _views_and_clicks(e: Stream, *columns) -> Stream:
    slim = ["event_id", "ts", "user_id"]  # what the join carries along
    views, clicks = (e.filter(F.col("event_type") == x).map(*slim) for x in ("view", "click"))
    return views.join(clicks, "user_id", "12 HOURS", *columns)


@stream("ttl_join", _TTL + "select k as user_id, view_id, click_id, matched_at, side_in from j")
def _ttl(e: Stream) -> DataFrame:
    return _views_and_clicks(e, F.col("key").alias("user_id"), F.col("left.event_id").alias("view_id"), F.col("right.event_id").alias("click_id"), "matched_at", F.col("by").alias("side_in")).df


@stream(
    "repartition_join_session_app",
    _TTL
    + """, f as (select *, sum(new) over (partition by k order by matched_at, view_id, click_id) as s from
       (select *, case when matched_at - lag(matched_at) over (partition by k order by matched_at, view_id, click_id) <= interval 24 hour then 0 else 1 end as new from j))
    select k as user_id, cast(count(*) as bigint) as n, min(matched_at) as window_start from f group by k, s""",
)
def _app(e: Stream) -> DataFrame:
    joined = _views_and_clicks(e.partition_by("user_id"), F.col("key").alias("user_id"), F.col("left.event_id").alias("view_id"), F.col("matched_at").alias("ts"))
    out = Stream(joined.df, "ts", "view_id").window(session_window(24 * HOUR, "user_id").agg(n=count_rows())).df
    return out.select("user_id", "n", "window_start")


# windows

_H = "time_bucket(interval 1 hour, ts)"
_D = "time_bucket(interval 1 day, ts, timestamp '1970-01-01')"
_CENTS = "cast(sum(cast(value as decimal(18,2))) as double)"


def _cents():
    return F.sum(F.col("value").cast("decimal(18,2)")).cast("double")


@stream("tumble_count", f"select user_id, {_H} as window_start, {_H} + interval 1 hour as window_end, cast(epoch_ms({_H}) as varchar) as pane_id, 'DEFAULT' as firing_type, count(*) as n, {_CENTS} as total from events group by user_id, {_H}")
def _tumble(e: Stream) -> DataFrame:
    return e.window(tumbling_window(HOUR, "user_id").agg(n=F.count(F.lit(1)), total=_cents())).df.drop("seq", "mode")


@stream("tumble_global", f"select {_D} as window_start, count(*) as n, max(value) as top from events group by {_D}")
def _global(e: Stream) -> DataFrame:
    return e.window(tumbling_window(24 * HOUR).agg(n=F.count(F.lit(1)), top=F.max("value"))).df.select("window_start", "n", "top")


@stream("tumble_collect", f"select user_id, {_D} as window_start, string_agg(cast(event_id as varchar), ',' order by ts, event_id) as ids from events group by user_id, {_D}")
def _collect(e: Stream) -> DataFrame:
    out = e.window(tumbling_window(24 * HOUR, "user_id").agg(rows=Collect(("event_id",)))).df
    return out.select("user_id", "window_start", F.array_join(F.transform("rows", lambda r: r["event_id"].cast("string")), ",").alias("ids"))


@stream("tumble_fold", f"select user_id, {_D} as window_start, cast(list_reduce(list_prepend(cast(7 as bigint), list(event_id order by ts, event_id)), lambda a, x: (a * 31 + x) % 1000003) as bigint) as h from events group by user_id, {_D}")
def _fold(e: Stream) -> DataFrame:
    fold = Fold(("event_id",), F.lit(7).cast("long"), lambda old, r: (old * 31 + r["event_id"]) % 1_000_003)
    return e.window(tumbling_window(24 * HOUR, "user_id").agg(h=fold)).df.select("user_id", "window_start", "h")


_SESSIONS = """with s as (select *, sum(new) over (partition by user_id order by ts, event_id) as s from
 (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 8 hour then 0 else 1 end as new from events))
"""


@stream("session_count", _SESSIONS + "select user_id, min(ts) as window_start, max(ts) + interval 8 hour as window_end, cast(epoch_us(min(ts)) // 1000 as varchar) as pane_id, count(*) as n from s group by user_id, s")
def _session(e: Stream) -> DataFrame:
    return e.window(session_window(8 * HOUR, "user_id").agg(n=count_rows())).df.select("user_id", "window_start", "window_end", "pane_id", "n")


_ALL = """with s as (select *, sum(new) over (order by ts, event_id) as s from (select *, case when ts - lag(ts) over (order by ts, event_id) <= interval 5 minute then 0 else 1 end as new from events))
"""


@stream("session_global", _ALL + "select min(ts) as window_start, max(ts) + interval 5 minute as window_end, count(*) as n, min(value) as low, max(value) as high from s group by s")
def _session_global(e: Stream) -> DataFrame:
    """Sessions of all rows, without a key."""
    return e.window(session_window(5 * MINUTE).agg(n=count_rows(), low=least_of("value"), high=most_of("value"))).df.select("window_start", "window_end", "n", "low", "high")


@stream("session_count_trigger", _SESSIONS + """, r as (select *, row_number() over (partition by user_id, s order by ts, event_id) as rn, min(ts) over (partition by user_id, s) as w from s)
    select user_id, w as window_start, (rn - 1) // 2 as seq, case when max(rn) % 2 = 0 then 'EARLY' else 'DEFAULT' end as firing_type, count(*) as n, max(value) as top from r group by user_id, w, (rn - 1) // 2""")
def _session_trigger(e: Stream) -> DataFrame:
    spec = session_window(8 * HOUR, "user_id").agg(n=count_rows(), top=F.max("value")).early_trigger(repeat(count(2))).accumulate("DISCARDING")
    return e.window(spec).df.select(*_PANE)


@stream("session_collect", _SESSIONS + "select user_id, min(ts) as window_start, string_agg(event_type, ',' order by ts, event_id) as types from s group by user_id, s")
def _session_collect(e: Stream) -> DataFrame:
    out = e.window(session_window(8 * HOUR, "user_id").agg(rows=Collect(("event_type",)))).df
    return out.select("user_id", "window_start", F.array_join(F.transform("rows", lambda r: r["event_type"]), ",").alias("types"))


_RN = f"""with r as (select user_id, value, {_D} as w, ts, event_id, row_number() over (partition by user_id, {_D} order by ts, event_id) as rn, count(*) over (partition by user_id, {_D}) as c from events)
"""
_PANE = ["user_id", "window_start", "seq", "firing_type", "n", "top"]


def _triggered(e: Stream, trigger, mode: str | None) -> DataFrame:
    spec = tumbling_window(24 * HOUR, "user_id").agg(n=F.count(F.lit(1)), top=F.max("value")).early_trigger(trigger)
    return e.window(spec.accumulate(mode) if mode else spec).df.select(*_PANE)


_ACCUMULATED = "(select max(value) from r x where x.user_id = r.user_id and x.w = r.w and x.rn <= r.rn)"


@stream(
    "count_trigger_discard",
    _RN + "select user_id, w as window_start, (rn - 1) // 2 as seq, case when max(rn) % 2 = 0 then 'EARLY' else 'DEFAULT' end as firing_type, count(*) as n, max(value) as top from r group by user_id, w, (rn - 1) // 2",
)
def _discard(e: Stream) -> DataFrame:
    return _triggered(e, repeat(count(2)), "DISCARDING")


@stream(
    "count_trigger_accumulate",
    _RN
    + """, m as (select *, max(value) over (partition by user_id, w order by rn) as so_far from r)
    select user_id, w as window_start, rn // 2 - 1 as seq, 'EARLY' as firing_type, rn as n, so_far as top from m where rn % 2 = 0
    union all select user_id, w, rn // 2, 'DEFAULT', rn, so_far from m where rn = c""",
)
def _accumulate(e: Stream) -> DataFrame:
    return _triggered(e, repeat(count(2)), "ACCUMULATING")


@stream(
    "count_trigger_once",
    _RN
    + """, m as (select *, max(value) over (partition by user_id, w order by rn) as so_far from r)
    select user_id, w as window_start, cast(0 as bigint) as seq, 'EARLY' as firing_type, rn as n, so_far as top from m where rn = 2
    union all select user_id, w, cast(case when c >= 2 then 1 else 0 end as bigint), 'DEFAULT', rn, so_far from m where rn = c""",
)
def _once(e: Stream) -> DataFrame:
    return _triggered(e, count(2), None)


@stream(
    "since_first_trigger_discard",
    _RN
    + """, f as (select *, min(ts) over (partition by user_id, w) as first from r),
    g as (select *, case when first + interval 6 hour < w + interval 1 day then ts < first + interval 6 hour else false end as early, first + interval 6 hour < w + interval 1 day as fires from f)
    select user_id, w as window_start, cast(case when fires and not early then 1 else 0 end as bigint) as seq, case when early then 'EARLY' else 'DEFAULT' end as firing_type, count(*) as n, max(value) as top
    from g group by user_id, w, early, fires""",
)
def _since_first(e: Stream) -> DataFrame:
    return _triggered(e, since_first(6 * HOUR), "DISCARDING")


@stream("composite_triggers", None)
def _composite(e: Stream) -> DataFrame:
    """Replayed, not expressible in SQL; tests hold it against a brute-force replay."""
    return _triggered(e, repeat(any_of(count(3), since_last(2 * HOUR), since_first(5 * HOUR))), "DISCARDING")


@stream(
    "since_last_trigger_discard",
    _RN
    + """, l as (select *, lead(ts) over (partition by user_id, w order by rn) as next from r),
    f as (select *, min(case when next >= ts + interval 2 hour or next is null and ts + interval 2 hour < w + interval 1 day then rn end) over (partition by user_id, w) as k from l)
    select user_id, w as window_start, cast(case when rn > k then 1 else 0 end as bigint) as seq, case when rn <= k then 'EARLY' else 'DEFAULT' end as firing_type, count(*) as n, max(value) as top
    from f group by all""",
)
def _since_last(e: Stream) -> DataFrame:
    return _triggered(e, since_last(2 * HOUR), "DISCARDING")


@stream(
    "any_trigger_discard",
    _RN
    + """, a as (select *, min(ts) over g + interval 6 hour as due, max(case when rn = 3 then ts end) over g as third from r window g as (partition by user_id, w)),
    f as (select *, case when third < due then 3 when due < w + interval 1 day then count(case when ts < due then 1 end) over (partition by user_id, w) end as k from a)
    select user_id, w as window_start, cast(case when rn > k then 1 else 0 end as bigint) as seq, case when rn <= k then 'EARLY' else 'DEFAULT' end as firing_type, count(*) as n, max(value) as top
    from f group by all""",
)
def _any(e: Stream) -> DataFrame:
    return _triggered(e, any_of(count(3), since_first(6 * HOUR)), "DISCARDING")


@stream(
    "accumulating_collect_and_fold",
    _RN
    + """, p as (select user_id, w, rn // 2 - 1 as seq, 'EARLY' as firing_type, rn as upto from r where rn % 2 = 0 union all select user_id, w, rn // 2, 'DEFAULT', rn from r where rn = c)
    select p.user_id, p.w as window_start, seq, firing_type, string_agg(cast(event_id as varchar), ',' order by rn) as ids, max(value) as top,
           cast(list_reduce(list_prepend(cast(7 as bigint), list(event_id order by rn)), lambda a, x: (a * 31 + x) % 1000003) as bigint) as h
    from p join r on r.user_id = p.user_id and r.w = p.w and rn <= upto group by all""",
)
def _accumulated(e: Stream) -> DataFrame:
    fold = Fold(("event_id",), F.lit(7).cast("long"), lambda old, r: (old * 31 + r["event_id"]) % 1_000_003)
    spec = tumbling_window(24 * HOUR, "user_id").agg(rows=Collect(("event_id",)), h=fold, top=F.max("value")).early_trigger(repeat(count(2)))
    ids = F.array_join(F.transform("rows", lambda r: r["event_id"].cast("string")), ",").alias("ids")
    return e.window(spec).df.select("user_id", "window_start", "seq", "firing_type", ids, "h", "top")


@stream("late_trigger_never_fires", f"select user_id, {_D} as window_start, cast(0 as bigint) as seq, 'DEFAULT' as firing_type, count(*) as n from events group by user_id, {_D}")
def _late(e: Stream) -> DataFrame:
    return e.window(tumbling_window(24 * HOUR, "user_id").agg(n=F.count(F.lit(1))).late_trigger(count(1))).df.select("user_id", "window_start", "seq", "firing_type", "n")


@stream("tumble_global_collect", f"select {_D} as window_start, string_agg(cast(event_id as varchar), ',' order by ts, event_id) as ids from events group by {_D}")
def _global_collect(e: Stream) -> DataFrame:
    out = e.window(tumbling_window(24 * HOUR).agg(rows=Collect(("event_id",)))).df
    return out.select("window_start", F.array_join(F.transform("rows", lambda r: r["event_id"].cast("string")), ",").alias("ids"))


# exchange


@stream("partition_by_places", "select case when user_id % 5 <> 0 then user_id else -1 end as k, count(*) as n, true as together from events group by 1")
def _places(e: Stream) -> DataFrame:
    """Where the exchange puts each key, nulls among them."""
    keyed = e.partition_by(F.when(F.col("user_id") % 5 != 0, F.col("user_id")), "event_id", partitions=8).df
    placed = keyed.withColumn("p", F.spark_partition_id())
    return placed.groupBy(F.coalesce("__key__", F.lit(-1)).alias("k")).agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("p") == 1).alias("together"))


@stream("group_tasks_by_partition", "select user_id % 8 as partition, count(*) as n, true as together from events group by 1")
def _tasks(e: Stream) -> DataFrame:
    rows = e.map("event_id", (F.col("user_id") % 8).alias("partition")).df
    placed = group_tasks(rows, "partition", 4).withColumn("p", F.spark_partition_id())
    return placed.groupBy("partition").agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("p") == 1).alias("together"))


@stream("partition_matchers", "select event_id, user_id % 16 as partition from events where user_id % 16 in (1, 3, 4, 5) or user_id % 16 between 10 and 15")
def _matchers(e: Stream) -> DataFrame:
    rows = e.map("event_id", (F.col("user_id") % 16).alias("partition"))
    return rows.filter(partitions_in("1,3-5") | partitions_matching("1[0-5]")).df


def _over(name: str, oracle: str) -> Callable[[Query], Query]:
    """A query over the session and the tables' folder."""

    def mark(fn: Query) -> Query:
        QUERIES[name], ORACLE_SQL[name] = fn, oracle
        return fn

    return mark


@_over("stream_lookup", "select c_custkey as user_id, event_id, c_name from events join customer on user_id = c_custkey")
def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"), "c_name")
    return events(spark, sf_dir).map("user_id", "event_id").lookup(names, "user_id").df


# functions, serdes, sources and sinks


@udf("long", vectorized=True)
class WordCountUdf:
    """Named by its class; takes and returns series."""

    def execute(self, text):
        return text.str.split().str.len()


@_over("sql_vectorized_udf", "select p_partkey, cast(len(string_split(p_name, ' ')) as bigint) as n from part")
def _vectorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = UdfRegistry()
    registry.add(WordCountUdf)
    return SqlEngine(spark, catalog(spark, sf_dir), registry).query("SELECT p_partkey, WordCount(p_name) AS n FROM src.part")


@stream(
    "serde_round_trips",
    """select event_id, printf('%016X', event_id) as wire, event_id as l, cast(user_id as integer) as i, event_type as s, value as d, '3FF8000000000000' as one_and_a_half, event_type as j, hex(encode(event_type)) as raw from events""",
)
def _serdes(e: Stream) -> DataFrame:
    back = lambda name, x: SERDES[name].decode(SERDES[name].encode(x))
    kind = F.create_map(F.lit("t"), F.col("event_type"))
    return e.df.select(
        "event_id",
        F.hex(SERDES["long"].encode(F.col("event_id"))).alias("wire"),
        back("long", F.col("event_id")).alias("l"),
        back("int", F.col("user_id").cast("int")).alias("i"),
        back("string", F.col("event_type")).alias("s"),
        back("double", F.col("value")).alias("d"),
        F.hex(SERDES["double"].encode(F.col("event_id") * 0 + 1.5)).alias("one_and_a_half"),
        back("json_map", kind)["t"].alias("j"),
        F.hex(back("bytes", F.encode("event_type", "UTF-8"))).alias("raw"),
    )


@stream("sink_rolling_files", "select event_id, value from events")
def _rolling(e: Stream) -> DataFrame:
    spark, path = e.df.sparkSession, scratch(e.df.sparkSession, "rolling")
    rolling_writer(e.map("event_id", "value").df, path, max_records=500)
    return spark.read.parquet(*snapshot(spark, path, allow=r".*\.parquet"))


@stream("sink_time_buckets", "select event_id, strftime(ts, '%Y_%m_%d-%H') as bucket, strftime(ts, '%Y_%m_%d-%H') as partition from events")
def _buckets(e: Stream) -> DataFrame:
    spark, path = e.df.sparkSession, scratch(e.df.sparkSession, "buckets")
    bucketed_writer(e.map("event_id", "ts").df, path, "ts", tasks=2)
    return directory_partitions(spark.read.parquet(path).select("event_id", "bucket"), "bucket=([^/]+)")


@_over(
    "avro_round_trip",
    """select event_id, user_id, event_type, value, epoch_us(ts) as us, event_type || ',none' as tags, hex(encode(event_type)) as raw, case when user_id % 3 = 0 then -1 else user_id end as maybe from events""",
)
def _avro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in Avro container files and back, read in splits of 64 KB."""
    register_sources(spark)
    path, rows = scratch(spark, "avro"), spark.read.parquet(f"{sf_dir}/events.parquet")
    wanted = ["event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"), F.array("event_type", F.lit(None)).alias("tags"), F.encode("event_type", "UTF-8").alias("raw"), F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("maybe")]
    rows.select(*wanted).write.format("tidewater_avro").option("blockBytes", 4096).mode("append").save(path)
    back = spark.read.format("tidewater_avro").option("splitBytes", 1 << 16).load(path)
    return back.withColumns({"raw": F.hex("raw"), "tags": F.array_join("tags", ",", "none"), "maybe": F.coalesce("maybe", F.lit(-1))}).withColumnRenamed("ts", "us")


@_over("avro_rolled_by_bytes", "select event_id, props, true as within from events")
def _avro_rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of 32 KB at most."""
    register_sources(spark)
    path, rows = scratch(spark, "rolled"), spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props")
    rows.write.format("tidewater_avro").option("codec", "null").option("blockBytes", 2048).option("rollBytes", 1 << 15).mode("append").save(path)
    largest = spark.read.format("binaryFile").load(path).agg(F.max("length") <= 1 << 15).first()[0]
    return spark.read.format("tidewater_avro").load(path).withColumn("within", F.lit(largest))


@_over("sequence_files", "select cast(event_id as varchar) as key, props as value, true as within from events")
def _sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence files of 64 KB at most, read back by Hadoop's own reader."""
    register_sources(spark)
    path, rows = scratch(spark, "sequence"), spark.read.parquet(f"{sf_dir}/events.parquet")
    rows.select(F.col("event_id").cast("string").alias("key"), F.col("props").alias("value")).write.format("tidewater_sequence").option("rollBytes", 1 << 16).mode("append").save(path)
    largest = spark.read.format("binaryFile").load(path).agg(F.max("length") <= 1 << 16).first()[0]
    return spark.createDataFrame(spark.sparkContext.sequenceFile(path), "key string, value string").withColumn("within", F.lit(largest))


@_over("tail_files", "select event_type || ' ' || event_id as line from events")
def _tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of files that come between runs of a query, which goes on from its checkpoint."""
    register_sources(spark)
    path, rows = scratch(spark, "tail"), spark.read.parquet(f"{sf_dir}/events.parquet")
    for k in range(2):
        rows.where(F.col("event_id") % 2 == k).select(F.concat_ws(" ", "event_type", "event_id")).write.mode("append").text(path + "-in")
        live = spark.readStream.format("tidewater_tail").option("pattern", "*.txt").option("splitBytes", 1 << 14).load(path + "-in").select("line")
        live.writeStream.format("parquet").option("checkpointLocation", path + "-log").trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema("line string").parquet(path)


@_over("sink_insert_script", "select cast(event_id as varchar) as __key__, event_id, value * 2 as v from events where event_type = 'click' union all select cast(event_id as varchar), event_id, value * 2 from events where event_type = 'view'")
def _script(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, path = catalog(spark, sf_dir), scratch(spark, "insert")
    tables.sink("out.v", parquet_sink(path))
    script = "-- two statements\n" + "\n".join(f"insert into out.v\n select __key__, event_id, value * 2 as v from src.events where event_type = '{x}'" for x in ("click", "view"))
    SqlEngine(spark, tables).execute(script)
    return spark.read.parquet(path)


def _as_stream(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """A table as an unbounded stream of its file."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parquet*")


def _drained(spark: SparkSession, query, path: str) -> DataFrame:
    query.awaitTermination()
    return spark.read.parquet(path)


@_over("streaming_insert", "select cast(event_id as varchar) as __key__, user_id, value + 1 as v from events where value > 20")
def _streaming_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL front end over an unbounded source, to files with a checkpoint."""
    path, tables = scratch(spark, "stream"), Catalog(spark)
    tables.source("live.events", lambda s: _as_stream(s, sf_dir), key="event_id")
    tables.sink("out.v", parquet_sink(path, checkpoint=path + "-log"))
    (query,) = SqlEngine(spark, tables).execute("INSERT INTO out.v SELECT __key__, user_id, value + 1 AS v FROM live.events WHERE value > 20")
    return _drained(spark, query, path)


@_over("streaming_sink", "select event_id, event_type from events where event_type <> 'view'")
def _streaming_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "sink")
    query = Stream(_as_stream(spark, sf_dir), "ts", "event_id").filter("event_type <> 'view'").map("event_id", "event_type").sink(lambda df, n: df.write.parquet(f"{path}/batch={n}"), path + "-log")
    return _drained(spark, query, path).select("event_id", "event_type")


@_over("streaming_upsert", "select cast(user_id as varchar) as __key__, arg_max(event_id, event_id) as event_id from events group by user_id")
def _streaming_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each key, as an upsert by key gets it from one micro-batch."""
    path = scratch(spark, "upsert")
    rows = _as_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("__key__"), "event_id", F.col("event_id").alias("__seq__"))
    return _drained(spark, upsert_sink(lambda df, n: df.write.parquet(f"{path}/batch={n}"), path + "-log")(rows), path).select("__key__", "event_id")


@stream("hopping_count", f"select user_id, {_H} - to_hours(k) as window_start, {_H} - to_hours(k) + interval 4 hour as window_end, count(*) as n from (select *, unnest([0, 1, 2, 3]) as k from events) group by all")
def _hopping(e: Stream) -> DataFrame:
    return e.window(hopping_window(4 * HOUR, HOUR, "user_id").agg(n=count_rows())).df.select("user_id", "window_start", "window_end", "n")


@stream("merge_by_priority", "select event_id, p as priority, row_number() over (partition by user_id order by p, ts, event_id) as turn from (select *, cast(case when event_type = 'view' then 1 else 0 end as integer) as p from events where event_type in ('view', 'click'))")
def _priority(e: Stream) -> DataFrame:
    """Clicks as a bootstrap input: each user's are handled before the user's views."""
    both = e.filter("event_type = 'click'").merge_by_priority(e.filter("event_type = 'view'")).df
    return both.select("event_id", "priority", F.row_number().over(W.partitionBy("user_id").orderBy("priority", "ts", "event_id")).cast("long").alias("turn"))


@stream("serde_drop_unreadable", """select event_id, cast(user_id as integer) as x, null as j from events where user_id % 3 <> 0 and user_id % 4 = 0
    union all select event_id, cast(user_id as integer), event_type from events where user_id % 3 <> 0 and user_id % 4 in (1, 2)""")
def _unreadable(e: Stream) -> DataFrame:
    """Messages that are no 4-byte numbers, or no JSON, are dropped; null bytes stay."""
    wire = F.when(F.col("user_id") % 3 == 0, F.lit("no number").cast("binary")).otherwise(SERDES["int"].encode(F.col("user_id").cast("int")))
    record = json("t string")
    text = F.when(F.col("user_id") % 4 == 3, F.lit('{"t" broken').cast("binary")).when(F.col("user_id") % 4 > 0, record.encode(F.struct(F.col("event_type").alias("t"))))
    rows = readable(e.map("event_id", wire.alias("x"), text.alias("j")).df, "x", SERDES["int"])
    return readable(rows, "j", record).withColumn("j", F.col("j.t"))


@stream("kafka_messages", """select 'clicks' as topic, cast(event_id as varchar) as key, '{"user_id":' || user_id || '}' as value, 1 as parts from events where event_type = 'click'""")
def _kafka(e: Stream) -> DataFrame:
    """Messages of a producer, dealt by user: all of a user's go to one partition."""
    made = kafka_messages(e.filter("event_type = 'click'").map("event_id", "user_id").df, "clicks", "event_id", "user_id", 16)
    user = F.get_json_object("value", "$.user_id")
    parts = made.groupBy(user.alias("user")).agg(F.countDistinct("partition").cast("int").alias("parts"))
    return made.withColumn("user", user).join(parts, "user").select("topic", "key", "value", "parts")


@stream("index_requests", """select 'shop' as index, 'event' as type, cast(event_id as varchar) as id, cast(user_id as varchar) as routing, '{"user_id":' || user_id || ',"event_type":"' || event_type || '"}' as source from events""")
def _requests(e: Stream) -> DataFrame:
    return index_requests(e.map("event_id", "user_id", "event_type").df, "shop/event", "event_id", "user_id")


# keyed state on unbounded streams, replayed to their end


def _stateful(spark: SparkSession, df: Callable[[], DataFrame], name: str, path: str | None = None) -> DataFrame:
    """What a stateful query has appended to files when it has read what is there."""
    kind, path = "spark.sql.streaming.stateStore.providerClass", path or scratch(spark, name)
    before = spark.conf.get(kind, None)
    spark.conf.set(kind, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        made = df()
        made.writeStream.format("parquet").option("checkpointLocation", path + "-log").outputMode("append").trigger(availableNow=True).start(path).awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(kind)
        else:
            spark.conf.set(kind, before)
    return spark.read.schema(made.schema).parquet(path)


#: Micro-batches of a replay; each holds rows of all times, so rows come out of order.
BATCHES = 3


def _batches(spark: SparkSession, sf_dir: str, columns: list[str]) -> list[DataFrame]:
    """The events in parts, each of all times."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return [rows.where(F.col("event_id") % BATCHES == k).select(columns) for k in range(BATCHES)]


def _fed(spark: SparkSession, parts: list[DataFrame], query: Callable[[DataFrame], DataFrame], name: str, delay: str | None = None) -> tuple[DataFrame, str]:
    """A query's appended rows, and its checkpoint. Each part is written and then read by a run of the query, which goes on from its checkpoint: a micro-batch or more for each, in this order."""
    path, schema = scratch(spark, name), parts[0].schema

    def made() -> DataFrame:
        live = spark.readStream.schema(schema).parquet(path + "-in")
        return query(to_event_time(live, "ts", delay) if delay else live)

    for part in parts:
        part.write.mode("append").parquet(path + "-in")
        out = _stateful(spark, made, name, path)
    return out, path + "-log"


@_over("streaming_ttl_join", _TTL + "select k as user_id, view_id, click_id, cast(epoch_us(matched_at) // 1000 as bigint) as ms from j")
def _streaming_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In batches of growing time; state leaves when the ttl has passed by both sides' watermark."""
    edges = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").crossJoin(F.broadcast(edges))  # one row of edges
    part = F.least(F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))) * BATCHES / (F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp")) + 1)), F.lit(BATCHES - 1))
    parts = [rows.where(part == k).select("event_id", "ts", "user_id", "event_type") for k in range(BATCHES)]

    def query(live: DataFrame) -> DataFrame:
        views, clicks = (live.where(F.col("event_type") == x).select("event_id", "ts", "user_id") for x in ("view", "click"))
        return join_streams(views, clicks, "user_id", "ts", "event_id", 12 * HOUR)

    own = {name: F.get_json_object(side, "$.event_id").cast("long").alias(name) for name, side in (("view_id", "left"), ("click_id", "right"))}
    return _fed(spark, parts, query, "join")[0].select(F.col("key").alias("user_id"), *own.values(), "ms")


_LATE = "400 days"  # nothing of the tables is later, so windows stay open until the end


def _streaming_panes(spark: SparkSession, sf_dir: str, kind: str, ms: int, values: dict, trigger=None, mode: str = "ACCUMULATING") -> DataFrame:
    """All panes of a stream whose rows come out of order, those at its end too."""
    columns = list(dict.fromkeys(["event_id", "ts", "user_id", *(c for v in values.values() for c in v.columns)]))
    panes, log = _fed(spark, _batches(spark, sf_dir, columns), lambda live: window_stream(live, kind, ms, "user_id", "ts", "event_id", values, trigger, mode), kind, _LATE)
    found = panes.unionByName(close_windows(spark, log, panes, kind, ms, values, trigger, mode))
    return found.withColumnRenamed("key", "user_id")


@_over("streaming_tumble", f"select user_id, cast(epoch_ms({_H}) as varchar) as pane_id, cast(0 as bigint) as seq, 'DEFAULT' as firing_type, count(*) as n, min(value) as low, max(value) as high from events group by user_id, {_H}")
def _streaming_tumble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streaming_panes(spark, sf_dir, "tumbling", HOUR, {"n": values.number(), "low": values.least("value"), "high": values.most("value")})


@_over(
    "streaming_session",
    _SESSIONS
    + """select user_id, cast(epoch_us(min(ts)) // 1000 as varchar) as pane_id, cast(0 as bigint) as seq, 'DEFAULT' as firing_type, count(*) as n,
                string_agg(event_type, ',' order by ts, event_id) as types from s group by user_id, s""",
)
def _streaming_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a stream whose batches fill each other's gaps, so that sessions join."""
    found = _streaming_panes(spark, sf_dir, "session", 8 * HOUR, {"n": values.number(), "types": values.rows("event_type", "string")})
    return found.withColumn("types", F.array_join("types", ","))


_ARRIVED = f"""with r as (select user_id, event_id, value, ts, {_D} as w, row_number() over (partition by user_id, {_D} order by event_id % {BATCHES}, ts, event_id) as rn,
 count(*) over (partition by user_id, {_D}) as c from events)
"""


@_over(
    "streaming_count_trigger",
    _ARRIVED
    + """select user_id, cast(epoch_ms(w) as varchar) as pane_id, (rn - 1) // 2 as seq, case when max(rn) % 2 = 0 then 'EARLY' else 'DEFAULT' end as firing_type, count(*) as n, max(value) as top,
                string_agg(cast(event_id as varchar), ',' order by ts, event_id) as ids from r group by user_id, w, (rn - 1) // 2""",
)
def _streaming_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DISCARDING panes of two rows; every row, late ones too, is in one."""
    wanted = {"n": values.number(), "top": values.most("value"), "ids": values.rows("event_id", "bigint")}
    return _streaming_panes(spark, sf_dir, "tumbling", 24 * HOUR, wanted, repeat(count(2)), "DISCARDING").withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@_over(
    "streaming_accumulate",
    _ARRIVED
    + """, m as (select *, max(value) over o as so_far, cast(sum(event_id) over o as bigint) as ids from r window o as (partition by user_id, w order by rn))
    select user_id, cast(epoch_ms(w) as varchar) as pane_id, rn // 3 - 1 as seq, 'EARLY' as firing_type, rn as n, so_far as top, ids from m where rn % 3 = 0
    union all select user_id, cast(epoch_ms(w) as varchar), rn // 3, 'DEFAULT', rn, so_far, ids from m where rn = c""",
)
def _streaming_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ACCUMULATING panes at every third row and at the end; state is a few numbers a window."""
    wanted = {"n": values.number(), "top": values.most("value"), "ids": values.total("event_id", "bigint")}
    return _streaming_panes(spark, sf_dir, "tumbling", 24 * HOUR, wanted, repeat(count(3)))


@_over(
    "streaming_fold",
    _ARRIVED
    + """select user_id, cast(epoch_ms(w) as varchar) as pane_id, cast(0 as bigint) as seq, 'DEFAULT' as firing_type,
                cast(list_reduce(list_prepend(cast(7 as bigint), list(event_id order by rn)), lambda a, x: (a * 31 + x) % 1000003) as bigint) as h from r group by user_id, w""",
)
def _streaming_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold over rows in the order in which they come."""
    fold = values.folded(7, lambda h, row: (h * 31 + row["event_id"]) % 1_000_003, "bigint", ("event_id",))
    return _streaming_panes(spark, sf_dir, "tumbling", 24 * HOUR, {"h": fold})


class Turns(Task):
    """A task that keeps a count for each key, gives every row its turn and at the end the count."""

    def process(self, key, row, store) -> list[tuple]:
        turn = int(store.get("n") or 0) + 1
        store.put("n", str(turn))
        return [(key, turn)]

    def end(self, key, store) -> list[tuple]:
        return [(key, -int(store.get("n")))]


@_over("streaming_task", "select user_id, row_number() over (partition by user_id) as turn from events union all select user_id, -count(*) from events group by user_id")
def _streaming_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each user's rows over several batches, and the last count, negative, when the stream ends."""
    schema = "user_id long, turn long"
    rows, log = _fed(spark, _batches(spark, sf_dir, ["user_id", "event_id"]), lambda live: run_task(live, "user_id", Turns(), schema), "task")
    return rows.unionByName(end_task(spark, log, "user_id", Turns(), schema))


class Recent(Task):
    """The rows of the last day at each row, from a time series; older ones are removed."""

    def process(self, key, row, store) -> list[tuple]:
        series, now = TimeSeries(store), int(row.ms)
        series.put("seen", str(row.event_id), now)
        series.remove("seen", 0, now - 24 * HOUR)
        found = series.get("seen", now - 24 * HOUR, now + 1)
        return [(key, row.event_id, len(found), sum(int(v) for _, v in found))]


@_over(
    "streaming_time_series",
    """select user_id, event_id, count(*) over w as n, cast(sum(event_id) over w as bigint) as ids from (select *, epoch_us(ts) // 1000 as ms, row_number() over (order by ts, event_id) as o from events)
       window w as (partition by user_id order by ms range between 86400000 preceding and current row exclude no others)""",
)
def _time_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows come in order of time; of rows at one millisecond each counts those before it."""
    schema = "user_id long, event_id long, n long, ids long"
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return _fed(spark, [rows], lambda live: run_task(live, "user_id", Recent(), schema, order=["ms", "event_id"]), "series")[0]


class Clicks(Task):
    """How many clicks of a bootstrap input a user has, at each view."""

    def bootstrap(self, key, row, store) -> None:
        store.put("clicks", str(int(store.get("clicks") or 0) + 1))

    def process(self, key, row, store) -> list[tuple]:
        return [(key, row.event_id, int(store.get("clicks") or 0))]


@_over("streaming_bootstrap", "select user_id, event_id, (select count(*) from events c where c.user_id = v.user_id and c.event_type = 'click') as clicks from events v where event_type = 'view'")
def _bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of a user's clicks are handled before the first view, in whatever batch it comes."""
    rows, schema = spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id long, event_id long, clicks long"
    clicks = rows.where("event_type = 'click'").select("user_id", "event_id")
    views = [part.where("event_type = 'view'").select("user_id", "event_id") for part in _batches(spark, sf_dir, ["user_id", "event_id", "event_type"])]
    return _fed(spark, views, lambda live: run_task(live, "user_id", Clicks(), schema, bootstrap=clicks), "bootstrap")[0]


@_over("streaming_shutdown", "select event_id, user_id from events")
def _shutdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query over an endless source that ends because its last row asks for it."""
    path, rows = scratch(spark, "shutdown"), spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.lit(False).alias(SHUTDOWN))
    rows.write.parquet(path + "-in")
    spark.range(1).select(F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("long").alias("user_id"), F.lit(True).alias(SHUTDOWN)).write.mode("append").parquet(path + "-in")
    live = spark.readStream.schema(rows.schema).parquet(path + "-in")
    run_until_shutdown(live, lambda df, n: df.write.parquet(f"{path}/batch={n}"), path + "-log")
    return spark.read.parquet(path).select("event_id", "user_id")


@stream("async_calls", "select event_id, user_id * 2 as twice from events where event_type <> 'view'")
def _async(e: Stream) -> DataFrame:
    """At most eight calls in flight in a task; None drops a row."""
    rows = e.map("event_id", "user_id", "event_type")
    return rows.map_batches(async_batches(_call, flight=8, timeout_s=60, retries=1), "event_id long, twice long").df


def _call(row: dict) -> dict | None:
    return None if row["event_type"] == "view" else {"event_id": row["event_id"], "twice": 2 * row["user_id"]}
