"""Operator 2: lines that much of a site repeats are dropped (DataFrame functions only).

A host's pages are its distinct texts, so that copies alone make no line boilerplate. A line's
ratio is the share of its host's pages that contain it. Lines with a ratio above ``ratio``
that are on two pages at least (a line of one page repeats nothing) are boilerplate of that
host and are dropped from all its rows; elsewhere they stay. The host is a column such as
a source, or an expression such as ``url_host("url")``.

A page's lines are made distinct before they are counted, so counts are summed before
the shuffle and a hot host or line costs each task one row. Lines and pages are counted by two
64-bit hashes, never shuffled as text. A host has at most (lines a page / ratio)
boilerplate lines. Their sets are joined to the pages: broadcast if they are measured
to be small, by a shuffle join otherwise.

Cases: lines are compared without blanks, tabs and carriage returns around them; empty lines
stay and are not counted as boilerplate; null texts stay null and are no page; empty texts have
one empty line; null hosts are one host; repeated rows and copies are one page of their host and are
all rewritten; an empty table gives an empty result; helper columns begin with ``_tw_``,
other names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, table

RATIO, LEAST_PAGES = 0.1, 2
BROADCAST_BYTES = 8_000_000
#: What is cut off the ends of a line before it is compared.
BLANKS = " \t\r\f\v"


def url_host(url_col: str) -> Column:
    """The host of a page's URL; null if there is none."""
    return F.lower(F.try_parse_url(F.col(url_col), F.lit("HOST")))


def _host(of: str | Column) -> Column:
    host = F.col(of) if isinstance(of, str) else of
    return F.when(host.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), host.cast("string")))


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _key(line):
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def boilerplate(docs: DataFrame, ratio: float = RATIO, host: str | Column = "source", text_col: str = "text") -> DataFrame:
    """_tw_host and _tw_drop, the set of its boilerplate lines' keys; hosts without any are left out."""
    page = [F.xxhash64(F.lit(k), text_col).alias(f"_tw_p{k}") for k in (0, 1)]
    lines = F.filter(F.transform(F.split(F.col(text_col), "\n"), _bare), lambda x: x != "")
    own = ["_tw_host", "_tw_p0", "_tw_p1"]
    keyed = docs.where(F.col(text_col).isNotNull()).select(_host(host).alias("_tw_host"), *page, F.array_distinct(lines).alias("_tw_lines"))
    found = keyed.select(*own, F.explode("_tw_lines").alias("_tw_line")).select(*own, F.xxhash64("_tw_line").alias("a"), F.xxhash64(F.lit(1), "_tw_line").alias("b")).distinct()
    counts = found.groupBy("_tw_host", "a", "b").agg(F.count(F.lit(1)).alias("_tw_n")).where(F.col("_tw_n") >= LEAST_PAGES)
    totals = keyed.select(*own).distinct().groupBy("_tw_host").agg(F.count(F.lit(1)).alias("_tw_pages"))
    common = counts.join(totals, "_tw_host").where(F.col("_tw_n") > F.lit(float(ratio)) * F.col("_tw_pages"))
    return common.groupBy("_tw_host").agg(F.collect_set(F.struct("a", "b")).alias("_tw_drop"))


def drop_boilerplate(docs: DataFrame, ratio: float = RATIO, host: str | Column = "source", text_col: str = "text") -> DataFrame:
    """The rows with their text rewritten, and _tw_lines and _tw_dropped, the lines before and those dropped."""
    sets = checkpoint(boilerplate(docs, ratio, host, text_col))
    held = sets.agg(F.coalesce(F.sum(16 * F.size("_tw_drop") + F.octet_length("_tw_host")), F.lit(0))).first()[0]
    joined = docs.withColumn("_tw_host", _host(host)).join(F.broadcast(sets) if held <= BROADCAST_BYTES else sets, "_tw_host", "left")
    lines = F.split(F.col(text_col), "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("_tw_drop"), _key(_bare(x))))
    joined = joined.withColumn("_tw_kept", F.when(F.col("_tw_drop").isNotNull(), kept))
    before = F.coalesce(F.size(lines), F.lit(0))
    dropped = F.when(F.col("_tw_kept").isNotNull(), F.size(lines) - F.size("_tw_kept")).otherwise(0)
    rewritten = F.when(F.col("_tw_kept").isNotNull(), F.array_join("_tw_kept", "\n")).otherwise(F.col(text_col))
    names = [rewritten.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return joined.select(*names, F.when(F.col(text_col).isNull(), 0).otherwise(before).cast("long").alias("_tw_lines"), dropped.cast("long").alias("_tw_dropped"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", F.col("_tw_lines").alias("n_lines"), F.col("_tw_dropped").alias("n_dropped"), "text")


_BLANKS = "chr(32) || chr(9) || chr(13) || chr(12) || chr(11)"
ORACLE_SQL = f"""
with p as (select distinct source, text from documents where text is not null),
l as (select source, unnest(list_distinct([trim(x, {_BLANKS}) for x in string_split(text, chr(10)) if trim(x, {_BLANKS}) <> ''])) as line from p),
n as (select source, line, count(*) as n from l group by all),
t as (select source, count(*) as pages from p group by all),
drops as (select n.source, list(line) as bad from n join t on n.source is not distinct from t.source
          where n >= {LEAST_PAGES} and n > cast({RATIO} as double) * pages group by all),
k as (select d.doc_id, d.source, d.text, string_split(d.text, chr(10)) as before,
             [x for x in string_split(d.text, chr(10)) if not list_contains(coalesce(bad, []), trim(x, {_BLANKS}))] as kept
      from documents d left join drops b on d.source is not distinct from b.source)
select doc_id, source, cast(coalesce(len(before), 0) as bigint) as n_lines, cast(coalesce(len(before) - len(kept), 0) as bigint) as n_dropped,
       array_to_string(kept, chr(10)) as text
from k
"""
