"""The time-bounded join: each arrival meets the latest row of its key on the other side.

A row of either side, when it arrives, replaces its side's row for the key and is
matched with the other side's latest one, if that is younger than the ttl. So a row can
match many times and an arrival gives one row at most. Arrival order is the event time,
ties by a unique column.

Both sides are one union, shuffled once by key and read once in order: no row meets any
other but its match, however many rows a key has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_join(left: DataFrame, right: DataFrame, key: str, time: str, tie: str, ttl: str, names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Structs ``left`` and ``right`` of matched rows, with ``key``, ``matched_at`` and ``by``, the side whose arrival matched.

    Rows with a null key or time match nothing. ``ttl`` is an interval such as '10 minutes'; a row
    exactly as old as it no longer matches.
    """
    sides = [(0, left), (1, right)]
    cast = [F.struct(*df.columns) for _, df in sides]
    parts = []
    for (i, df), row in zip(sides, cast, strict=True):
        other = F.lit(None).cast(f"struct<{','.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in sides[1 - i][1].schema)}>")
        rows = [row, other] if i == 0 else [other, row]
        parts.append(df.select(F.col(key).alias("key"), F.col(time).alias("_t"), F.col(tie).alias("_tie"), F.lit(i).alias("_side"), rows[0].alias("_l"), rows[1].alias("_r")))
    both = parts[0].unionByName(parts[1]).where(F.col("key").isNotNull() & F.col("_t").isNotNull())
    before = Window.partitionBy("key").orderBy("_t", "_tie", "_side").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("_last_l", F.last(F.when(F.col("_side") == 0, F.struct("_t", "_l")), ignorenulls=True).over(before))
    both = both.withColumn("_last_r", F.last(F.when(F.col("_side") == 1, F.struct("_t", "_r")), ignorenulls=True).over(before))
    mate = F.when(F.col("_side") == 0, F.col("_last_r._t")).otherwise(F.col("_last_l._t"))
    matched = both.where(mate > F.col("_t") - F.expr(f"INTERVAL {ttl}"))
    return matched.select(
        "key",
        F.when(F.col("_side") == 0, F.col("_l")).otherwise(F.col("_last_l._l")).alias(names[0]),
        F.when(F.col("_side") == 1, F.col("_r")).otherwise(F.col("_last_r._r")).alias(names[1]),
        F.col("_t").alias("matched_at"),
        F.when(F.col("_side") == 0, F.lit(names[0])).otherwise(F.lit(names[1])).alias("by"),
    )
