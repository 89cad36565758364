"""Choices about partitions: how many, which, and who reads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stream import MAX_PARTITIONS


def partition_count(inputs: list[int], outputs: list[int], joined: list[int] | None = None, configured: int | None = None) -> int:
    """Partitions of an exchange: those of the joined inputs, which must agree; else the configured number; else the most of inputs and outputs, up to 256."""
    if joined:
        if len(set(joined)) > 1:
            raise ValueError(f"joined streams have different partition counts: {joined}")
        return joined[0]
    if configured:
        return configured
    return min(MAX_PARTITIONS, max([*inputs, *outputs], default=1))


def partitions_matching(pattern: str, column: str = "partition") -> Column:
    """Partitions whose number matches all of a pattern."""
    return F.col(column).cast("string").rlike(f"^(?:{pattern})$")


def partitions_in(ranges: str, column: str = "partition") -> Column:
    """Partitions in a list such as ``1,3-5``."""
    found = F.lit(False)
    for part in ranges.split(","):
        low, _, high = part.strip().partition("-")
        found = found | F.col(column).between(int(low), int(high or low))
    return found


def group_tasks(df: DataFrame, how: str, partitions: int | None = None) -> DataFrame:
    """Rows dealt to tasks: ``partition`` (the same partition of all streams together), ``stream`` (each stream's partition alone), ``all`` (one task)."""
    if how == "all":
        return df.coalesce(1)
    keys = {"partition": ["partition"], "stream": ["stream", "partition"]}
    if how not in keys:
        raise ValueError(f"no grouping {how}")
    return df.repartition(partitions, *keys[how]) if partitions else df.repartition(*keys[how])
