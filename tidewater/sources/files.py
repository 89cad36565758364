"""Directories as partitioned sources, and writers that roll or bucket."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def snapshot(spark: SparkSession, path: str, allow: str = ".*", deny: str = "$^", before: list[str] | None = None) -> list[str]:
    """The files below a directory now, sorted by path, whose names match ``allow`` and not ``deny``.

    With ``before``, an earlier snapshot: new files are left out, a vanished one is an error.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found, walk = [], system.listFiles(hadoop, True)
    while walk.hasNext():
        at = walk.next().getPath()
        if re.fullmatch(allow, at.getName()) and not re.fullmatch(deny, at.getName()):
            found.append(at.toString())
    if before is None:
        return sorted(found)
    if gone := sorted(set(before) - set(found)):
        raise FileNotFoundError(f"files of the snapshot have gone: {', '.join(gone)}")
    return list(before)


def directory_partitions(df: DataFrame, group: str, partitions: int | None = None) -> DataFrame:
    """Rows with ``partition``, the group that ``group`` (a pattern with one group) finds in their file's path, dealt by it."""
    out = df.withColumn("partition", F.regexp_extract(F.input_file_name(), group, 1))
    return out.repartition(partitions, "partition") if partitions else out.repartition("partition")


def rolling_writer(df: DataFrame, path: str, kind: str = "parquet", max_records: int = 262_144, mode: str = "append") -> None:
    """Files of at most ``max_records`` rows."""
    df.write.mode(mode).format(kind).option("maxRecordsPerFile", max_records).save(path)


def bucketed_writer(df: DataFrame, path: str, time: str, kind: str = "parquet", pattern: str = "yyyy_MM_dd-HH", max_records: int = 262_144, mode: str = "append", tasks: int = 8) -> None:
    """A folder for each time bucket; rows of a bucket are gathered first in ``tasks`` tasks, so that a bucket has few files and a full one needn't fit one task."""
    out = df.withColumn("bucket", F.date_format(time, pattern))
    salt = [F.pmod(F.xxhash64(*[F.col(c) for c, kind in df.dtypes if not kind.startswith("map")]), F.lit(tasks))] if tasks > 1 else []
    out.repartition("bucket", *salt).write.mode(mode).format(kind).option("maxRecordsPerFile", max_records).partitionBy("bucket").save(path)
