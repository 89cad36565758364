"""A fluent stream over a DataFrame, bounded or not.

A stream knows its event time and a column that breaks ties, so that what depends on
arrival order is reproducible. Every step is a lazy DataFrame transformation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.catalog import KEY, Catalog
from .joins import latest_join
from .windows import Window, panes

#: Partitions of an exchange for which nothing else is said are at most so many.
MAX_PARTITIONS = 256
#: The most bytes of a table that is broadcast.
BROADCAST_BYTES = 32_000_000


@dataclass(frozen=True)
class Stream:
    df: DataFrame
    time: str | None = None
    tie: str | None = None

    def _with(self, df: DataFrame) -> Stream:
        keep = lambda c: c if c in df.columns else None
        return replace(self, df=df, time=keep(self.time), tie=keep(self.tie))

    # one row to one, some or no rows

    def map(self, *columns: Column | str, drop_null: str | None = None) -> Stream:
        """One row each; with ``drop_null``, rows whose column of that name is null are dropped."""
        out = self.df.select(*columns)
        return self._with(out.where(F.col(drop_null).isNotNull()) if drop_null else out)

    def flat_map(self, items: Column, name: str = "value", keep: list[str] | None = None) -> Stream:
        """A row for each item of an array; null and empty arrays give none."""
        return self._with(self.df.select(*(keep or []), F.explode(items).alias(name)))

    def flatten(self, column: str) -> Stream:
        """A row for each element; an empty array gives none, a null one a null element."""
        items = F.coalesce(F.col(column), F.array(F.lit(None)))
        others = [c for c in self.df.columns if c != column]
        return self._with(self.df.select(*others, F.explode(items).alias(column)))

    def map_batches(self, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> Stream:
        """Python over Arrow batches, for what no expression can say; set up once in ``fn``, before its loop."""
        return self._with(self.df.mapInPandas(fn, schema))

    def filter(self, condition: Column | str) -> Stream:
        """Rows for which the condition is true; null drops a row."""
        return self._with(self.df.where(condition))

    # exchange

    def partition_by(self, key: Column | str, *values: Column | str, partitions: int | None = None) -> Stream:
        """Key and values, dealt by key over so many partitions; null keys share one. Without a number the step that needs rows by key (a join, a window, a write by key) deals them, so that no row is shuffled twice."""
        key = F.col(key) if isinstance(key, str) else key
        kept = list(values) or ["*"]
        out = self.df.select(key.alias(KEY), *kept)
        n = min(partitions, MAX_PARTITIONS) if partitions else None
        return self._with(out.repartition(n, KEY) if n else out)

    def merge(self, *others: Stream) -> Stream:
        """All rows of all streams; a stream that is merged with itself is there once."""
        seen: list[DataFrame] = []
        for df in [self.df, *(x.df for x in others)]:
            if not any(df is x for x in seen):
                seen.append(df)
        out = seen[0]
        for df in seen[1:]:
            out = out.unionByName(df)
        return self._with(out)

    def merge_by_priority(self, *others: Stream, name: str = "priority") -> Stream:
        """All rows of all streams with the place of their stream in this list, so that what orders rows by it handles the first stream's before all others (a bootstrap input, then the rest)."""
        parts = [x.df.withColumn(name, F.lit(i)) for i, x in enumerate([self, *others])]
        return self._with(parts[0]).merge(*(self._with(x) for x in parts[1:]))

    @staticmethod
    def merge_all(streams: list[Stream]) -> Stream:
        if not streams:
            raise ValueError("nothing to merge")
        return streams[0].merge(*streams[1:])

    def lookup(self, table: DataFrame, on: str | list[str], how: str = "inner", limit: int = BROADCAST_BYTES) -> Stream:
        """Rows with those of a bounded table that have their key. The table is broadcast if its rows, measured as JSON, have at most ``limit`` bytes, else both sides are shuffled."""
        size = table.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*table.columns)))), F.lit(0))).first()[0]
        return self._with(self.df.join(F.broadcast(table) if size <= limit else table, on, how))

    # state

    def _ordered(self) -> tuple[str, str]:
        if not self.time or not self.tie:
            raise ValueError("this needs the stream's event time and tie-breaker")
        return self.time, self.tie

    def join(self, other: Stream, key: str, ttl: str, *columns: Column | str) -> Stream:
        """Each arrival with the other side's latest row of its key (see ``latest_join``)."""
        if other.df is self.df:
            raise ValueError("a stream can't be joined with itself")
        time, tie = self._ordered()
        if other._ordered() != (time, tie):
            raise ValueError("both sides name their event time and tie-breaker alike")
        out = latest_join(self.df, other.df, key, time, tie, ttl)
        return replace(self, df=out.select(*columns) if columns else out, time="matched_at", tie=None)._with(out.select(*columns) if columns else out)

    def window(self, spec: Window) -> Stream:
        """The window's panes."""
        time, tie = self._ordered()
        return replace(self, df=panes(self.df, spec, time, tie), time="window_end", tie=None)

    # ends

    def sink(self, fn: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> StreamingQuery | None:
        """Each micro-batch (a bounded stream is one) to a function."""
        if self.df.isStreaming:
            out = self.df.writeStream.foreachBatch(fn).trigger(availableNow=True)
            return (out.option("checkpointLocation", checkpoint) if checkpoint else out).start()
        fn(self.df, 0)
        return None


@dataclass
class Graph:
    """Named inputs and outputs of an application."""

    catalog: Catalog
    started: list[StreamingQuery | None] = field(default_factory=list)

    def input(self, name: str) -> Stream:
        source = self.catalog.sources[self.catalog._name(name)]
        return Stream(source.frame(self.catalog.spark), source.event_time, source.tie)

    def output(self, name: str, stream: Stream) -> None:
        self.started.append(self.catalog.output(name).write(stream.df))
