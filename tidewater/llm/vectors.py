"""Vector columns as numpy blocks, for the operators over embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of doubles that one vectorised step takes at a time.
BLOCK_BYTES = 4_000_000
#: Whole numbers up to here are exact as doubles.
EXACT = 1 << 53


def usable(vector: str) -> Column:
    """Whether a vector is neither null nor empty and all its entries are finite numbers."""
    at = F.col(vector)
    return at.isNotNull() & (F.size(at) > 0) & F.forall(at, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))


def of_one_length(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows with a usable vector of the commonest length (the larger one of two as common), and that length; 0 if there is none."""
    rows = rows.where(usable(vector))
    most = rows.groupBy(F.size(vector).alias("_tw_size")).count().orderBy(F.desc("count"), F.desc("_tw_size")).first()
    size = most["_tw_size"] if most else 0
    return rows.where(F.size(vector) == size), size


def step_rows(size: int) -> int:
    """Rows of vectors of a size that a step takes."""
    return max(1, BLOCK_BYTES // (8 * size))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """A list column without nulls as a matrix of doubles."""
    return np.asarray(column.flatten(), np.float64).reshape(-1, size)


def steps(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, step_rows(size)):
            yield batch.slice(start, step_rows(size))


def scaled(values: np.ndarray, by: int, limit: int) -> np.ndarray:
    """floor(by * value) as long; beyond the limit sums would not be exact, which is an error."""
    out = np.floor(by * values)
    if out.size and np.abs(out).max() > limit:
        raise ValueError(f"a vector's entry is beyond {limit / by:.4g}")
    return out.astype(np.int64)
