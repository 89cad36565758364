"""Event time on unbounded streams, and their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def to_event_time(df: DataFrame, time: str, delay: str) -> DataFrame:
    """A watermark over a time column; a time without zone is read in the session's zone first, which a watermark needs."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def replay(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 1, kind: str = "parquet") -> DataFrame:
    """A directory of files as a stream, a bounded number of files in each micro-batch."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def flush_with_sentinel(query_of, stream: DataFrame, sentinel: DataFrame) -> StreamingQuery:
    """End of stream: a last row far in the future closes every open window.

    ``query_of`` makes the query from a frame; the sentinel has the stream's columns, a key of its own, and is filtered from the output by it.
    """
    return query_of(stream.unionByName(sentinel))
