"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship_package

__all__ = ["STEP_BYTES", "WORD_BYTES", "blobs", "checkpoint", "coded_words", "drops", "hashed_sample", "shared_dir", "ship", "slices", "table", "task", "tokenizer_path", "trim", "with_columns", "words"]

#: Upper-case ASCII to lower case; every byte that cannot be in a word to a blank.
#: A word is a run of 0-9, a-z and bytes of non-ASCII characters, which in UTF-8
#: is the pattern ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` over the lower-cased text.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
#: Bytes of text that one vectorised step takes at a time.
STEP_BYTES = 2_000_000
#: Bytes of a batch that goes to or comes from a Python worker, unless one row has more: the JVM's buffers and the worker hold several.
BATCH_BYTES = 4_000_000
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors; Arrow batches of the session get small enough for wide rows."""
    if int(spark.conf.get(_BATCH_CONF).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    return ship_package(spark)


def words(text: bytes | None) -> list[bytes]:
    """The lower-cased words of a text; none for null."""
    return text.translate(WORD_BYTES).split() if text else []


def blobs(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string or binary column as bytes objects."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.binary() if column.type in (pa.string(), pa.binary()) else pa.large_binary()).to_pylist()


def coded_words(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words between ASCII white space of some texts, A-Z in lower case; for all words in a row the place of each there; and their number in each text. Null has none."""
    kind = pa.large_string() if column.type in (pa.large_string(), pa.large_binary()) else pa.string()
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column.view(kind)))
    coded = lists.flatten().dictionary_encode()
    words, index = coded.dictionary.cast(pa.large_binary()), coded.indices.to_numpy()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    none = pc.index(words, pa.scalar(b"", words.type)).as_py()
    if none >= 0:  # what is before or after white space at the edges
        words = pa.concat_arrays([words[:none], words[none + 1 :]])
        kept = index != none
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[kept], minlength=len(sizes))
        index = index[kept]
        index = index - (index > none)
    return words, index, sizes


def slices(batch: pa.RecordBatch, text: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


_operator: list[str] = []
#: What drops the caches that operators keep in a Python worker between tasks.
drops: list[Callable[[], None]] = []


def trim() -> None:
    """Give freed memory back: a process that goes on would hold it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def task(operator: str) -> Callable:
    """Mark a function over batches as an operator's: a worker drops the caches of the operator before, and its freed memory after each task."""

    def mark(fn: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
        def run(batches: Iterator) -> Iterator:
            if _operator != [operator]:
                _operator[:] = [operator]
                for drop in drops:
                    drop()
                gc.collect()
                trim()
            try:
                yield from fn(batches)
            finally:
                trim()

        return run

    return mark


def with_columns(schema: StructType, ddl: str) -> StructType:
    """A schema with further columns, given as DDL."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = named.get() if named.isDefined() else None
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidewater-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and go on from the files: a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hashed_sample(rows: DataFrame, column: str, n: int) -> DataFrame:
    """At most n rows with different values of a column, those of the least hashes. Hashes alone are ordered, so few rows travel however many tasks there are."""
    found = F.xxhash64(column)
    last = rows.select(found.alias("_tw_hash")).distinct().orderBy("_tw_hash").limit(n).agg(F.max("_tw_hash")).first()[0]
    return rows.where(found <= F.lit(last)).withColumn("_tw_hash", found).dropDuplicates(["_tw_hash"]).orderBy("_tw_hash")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json", folder: str | None = None) -> str:
    """Place of a public vocabulary file; ``folder`` or $TOKENIZER_DIR override the installed package."""
    folder = folder or os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
