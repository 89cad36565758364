"""Operator 6: shards that each match the mixture, by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source. A row's rank over
its source's size is its fractional rank; the table in order of fractional rank has
every source spread evenly over it, and is cut into shards whose counts differ by one
row at most (the law ``rows``).

Ranks are exact and no task sees a whole source: the hash cuts a source into buckets of
about ``bucket_rows`` rows, counts per bucket give the rows before a bucket, and a
window numbers the rows within it. Fractional ranks are numbered in the same way. One
source with most of the rows, or very many sources with one row each (each source's
ranks are shifted by a fraction of its own), fill the buckets alike.

Cases: a null source is a stratum of its own; a null text has size 8 and the checksum
of no bytes; an empty text has the same; ties of the hash go by id, then checksum;
repeated rows each take a slot; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, table

SHARDS, SEED, BUCKET_ROWS = 24, 20_240_607, 20_000


def _unit(column):
    """A 64-bit hash as a number from 0 to below 1, in the hash's order."""
    return F.least(column / F.lit(2.0**64) + F.lit(0.5), F.lit(1 - 2.0**-53))


def _offsets(df: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """For each bucket, the rows in the buckets before it that share ``keys``."""
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_rows"))
    return counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))


def interleave(
    docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "source", bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """doc_id, size, text_crc32, stratum, frac, shard, slot for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    stratum = F.when(F.col(stratum_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(stratum_col).cast("string")))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), stratum.alias("stratum")
    )
    rows = checkpoint(rows.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32")))
    total = rows.count()
    parts = max(1, -(-total // bucket_rows))
    rows = rows.withColumn("_b", F.floor(_unit(F.col("_h")) * parts).cast("int"))
    counts = _offsets(rows, ["stratum"], "_b")
    counts = counts.withColumn("_of", F.sum("_rows").over(Window.partitionBy("stratum")))
    order = Window.partitionBy("stratum", "_b").orderBy("_h", "doc_id", "text_crc32")
    ranked = rows.join(counts, ["stratum", "_b"]).withColumn("_rank", F.col("_before") + F.row_number().over(order))
    shift = _unit(F.xxhash64(F.lit(seed), F.lit("shift"), "stratum"))
    ranked = ranked.withColumn("frac", (F.col("_rank") - 1 + shift) / F.col("_of")).drop("_b", "_rows", "_before", "_rank", "_of")
    ranked = checkpoint(ranked.withColumn("_p", F.least(F.floor(F.col("frac") * parts), F.lit(parts - 1)).cast("int")))
    order = Window.partitionBy("_p").orderBy("frac", "stratum", "_h", "doc_id", "text_crc32")
    places = ranked.join(_offsets(ranked, [], "_p"), "_p").withColumn("_at", F.col("_before") + F.row_number().over(order) - 1)
    places = places.withColumn("shard", F.expr(f"cast(_at * {shards} div {max(total, 1)} as int)"))
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}) div {shards}")
    return places.withColumn("slot", F.col("_at") - first).select("doc_id", "size", "text_crc32", "stratum", "frac", "shard", "slot")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = interleave(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
