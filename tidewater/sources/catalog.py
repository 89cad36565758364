"""The catalog: ``system.stream`` to a reader or a writer.

A source is a frame or a function that makes one, so a bounded and an unbounded source
look the same to what follows. Every source is seen with a nullable string column
``__key__`` first: the message key, or null where the source names none.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

KEY = "__key__"


@dataclass
class Source:
    """A named input. ``schema`` is checked when it is read; ``key`` names the column that is the message key."""

    name: str
    read: Callable[[SparkSession], DataFrame]
    key: str | None = None
    schema: StructType | None = None
    event_time: str | None = None
    tie: str | None = None

    def frame(self, spark: SparkSession) -> DataFrame:
        df = self.read(spark)
        if self.schema is not None:
            missing = [f.name for f in self.schema if f.name not in df.columns or df.schema[f.name].dataType != f.dataType]
            if missing:
                raise ValueError(f"{self.name}: columns differ from the schema: {', '.join(missing)}")
            df = df.select(self.schema.names)
        if KEY in df.columns:
            return df.select(KEY, *[c for c in df.columns if c != KEY])
        key = F.col(self.key).cast("string") if self.key else F.lit(None).cast("string")
        return df.select(key.alias(KEY), "*")


@dataclass
class Sink:
    """A named output. ``write`` takes the frame; the key column stays where the query named one."""

    name: str
    write: Callable[[DataFrame], StreamingQuery | None]


def parquet_sink(path: str, mode: str = "append", checkpoint: str | None = None) -> Callable[[DataFrame], StreamingQuery | None]:
    return format_sink("parquet", path, mode, checkpoint)


def format_sink(kind: str, path: str | None = None, mode: str = "append", checkpoint: str | None = None, **options: str) -> Callable[[DataFrame], StreamingQuery | None]:
    """Any Spark format, for bounded and unbounded frames: parquet, json, orc, text, console, memory, kafka, ..."""

    def write(df: DataFrame) -> StreamingQuery | None:
        if df.isStreaming:
            out = df.writeStream.format(kind).options(**options).trigger(availableNow=True)
            out = out.option("checkpointLocation", checkpoint) if checkpoint else out
            return out.start(path) if path else out.start()
        out = df.write.format(kind).options(**options).mode(mode)
        return out.save(path) if path else out.save()

    return write


def json_messages(df: DataFrame, key: str | None = KEY) -> DataFrame:
    """Rows as (key, value) messages with the value in JSON; nulls are left out of it."""
    key_column = F.col(key).cast("string") if key in df.columns else F.lit(None).cast("string")
    return df.select(key_column.alias("key"), F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("value"))


def keyed_partition(key: str, partitions: int):
    """The partition that a keyed message goes to; null keys go to partition 0."""
    return F.when(F.col(key).isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(key), F.lit(partitions))).cast("int")


def upsert_sink(apply: Callable[[DataFrame, int], None], checkpoint: str) -> Callable[[DataFrame], StreamingQuery | None]:
    """Each micro-batch, one row for each key (the last by offset column ``__seq__`` if there is one), to a function that upserts by key."""

    def batch(df: DataFrame, epoch: int) -> None:
        if "__seq__" in df.columns:
            rest = [c for c in df.columns if c != KEY]
            df = df.groupBy(KEY).agg(F.max_by(F.struct(*rest), "__seq__").alias("_x")).select(KEY, "_x.*").drop("__seq__")
        apply(df, epoch)

    def write(df: DataFrame) -> StreamingQuery | None:
        if df.isStreaming:
            return df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        batch(df, 0)
        return None

    return write


@dataclass
class Catalog:
    spark: SparkSession
    sources: dict[str, Source] = field(default_factory=dict)
    sinks: dict[str, Sink] = field(default_factory=dict)

    @staticmethod
    def _name(name: str) -> str:
        parts = name.replace("`", "").split(".")
        if len(parts) != 2 or not all(parts):
            raise ValueError(f"{name}: a stream has two parts, system.stream")
        return ".".join(parts)

    def source(self, name: str, read: Callable[[SparkSession], DataFrame] | DataFrame, **more) -> Source:
        made = read if callable(read) else (lambda _, df=read: df)
        found = self.sources[self._name(name)] = Source(self._name(name), made, **more)
        return found

    def sink(self, name: str, write: Callable[[DataFrame], StreamingQuery | None]) -> Sink:
        found = self.sinks[self._name(name)] = Sink(self._name(name), write)
        return found

    def view(self, name: str) -> str:
        """A temporary view over a source; its name."""
        name = self._name(name)
        if name not in self.sources:
            raise KeyError(f"no source {name}")
        view = "tw_" + name.replace(".", "__")
        self.sources[name].frame(self.spark).createOrReplaceTempView(view)
        return view

    def output(self, name: str) -> Sink:
        name = self._name(name)
        if name not in self.sinks:
            raise KeyError(f"no sink {name}")
        return self.sinks[name]
