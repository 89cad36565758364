"""Operator 12: PCA whitening of embeddings by a tall-skinny QR factorisation (TSQR).

Entries become whole numbers, so the sums of the dimensions, and with them the centre, are
exact. Each task folds its centred rows, step by step, into one triangular factor R; the
factors are merged in a tree of shuffles (``fan`` of them at a node, fewer where they are
large) until one is left; its singular value decomposition gives the right vectors and
the variances. No covariance is formed to find them.

Held at once: a step of rows and one factor in a task, ``FAN_BYTES`` of factors at a node,
one factor (dimensions squared) on the driver, whatever the number of rows.

Cases: rows whose vector is null, empty, or has null or non-finite entries take no part;
of vectors of several lengths those of the commonest one do (the larger of two as common);
a component without variance (a rank below the number of components, one row) is whitened
to null and left out of the identity error, without any variance ``explained`` and the
error are null; fewer dimensions give fewer components; repeated rows count each, ids may
be null or repeated; a deviation beyond a long is null (``deviation_decimal`` has it up to
38 digits); entries beyond 2^30 are an error; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, ship, table, task, with_columns
from .vectors import EXACT, matrix, of_one_length, scaled, step_rows, steps

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Factors merged at a node of the tree, and their bytes.
FAN, FAN_BYTES = 16, 64_000_000
#: Entries of a vector times SCALE are at most this large.
LIMIT = 1 << 40
#: Components whose singular value is below this share of the largest have no variance.
RANK = 1e-12
_MERGED = "node long, factor binary"


def _whole(values: np.ndarray) -> np.ndarray:
    return scaled(values, SCALE, LIMIT) + SHIFT


@dataclass(frozen=True)
class Whitening:
    """What whitens rows: their number and exact sums, components as columns, standard deviations and shares of the variance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray

    def centred(self, values: np.ndarray) -> np.ndarray:
        return _centred(values, self.n, self.sums)

    def whiten(self, values: np.ndarray) -> np.ndarray:
        """The rows' whitened components; null (NaN) without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.centred(values) @ self.vectors / np.where(self.deviations > 0, self.deviations, np.nan)

    def deviation(self, values: np.ndarray) -> list[int]:
        """Exact sums of (n x - S)^2 of the rows."""
        d = _numerators(values, self.n, self.sums)
        if d.dtype == object or d.size and int(np.abs(d).max()) ** 2 * d.shape[1] >= 1 << 63:
            return [sum(int(x) ** 2 for x in row) for row in d]
        return (d * d).sum(1).tolist()


def _numerators(values: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact."""
    x = _whole(values)
    if n * (int(np.abs(x).max()) if x.size else 0) + max(map(abs, sums)) >= 1 << 63:
        return x.astype(object) * n - np.array(sums, object)
    return x * n - np.array(sums, np.int64)


def _centred(values: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    d = _numerators(values, n, sums)
    if d.dtype != object and d.size and np.abs(d).max() < EXACT:
        return d / n
    return np.array([[int(x) / n for x in row] for row in d]).reshape(d.shape)


def totals(rows: DataFrame, vector: str, size: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension."""

    @task("whitening")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(size, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([sums.tolist()], pa.list_(pa.int64()))], names=["n", "sums"])

        for batch in steps(batches, size):
            n += batch.num_rows
            sums += _whole(matrix(batch.column(0), size)).sum(0)
            if n >= 1 << 20:  # far from what a long holds
                yield out()
                n, sums = 0, np.zeros(size, np.int64)
        yield out()

    parts = rows.select(vector).mapInArrow(run, "n long, sums array<long>")
    found = parts.select("n", F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    return (found[0]["n"], [int(r["x"]) for r in sorted(found, key=lambda r: r["at"])]) if found else (0, [0] * size)


def _folded(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows if r is None else np.vstack([r, rows]), mode="r")


def _factor(rows: DataFrame, vector: str, size: int, n: int, sums: list[int], fan: int) -> np.ndarray:
    """R of all centred rows."""

    def packed(node: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["node", "factor"])

    @task("whitening")
    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in steps(batches, size):
            r = _folded(r, _centred(matrix(batch.column(0), size), n, sums))
        if r is not None:
            yield packed(TaskContext.get().partitionId(), r)

    def merge(key: tuple, found: pa.Table) -> pa.Table:
        r = None
        for x in sorted(found.column("factor").to_pylist()):
            r = _folded(r, np.frombuffer(x).reshape(-1, size))
        return pa.Table.from_batches([packed(key[0].as_py(), r)])

    fan = max(2, min(fan, FAN_BYTES // (8 * size * size)))
    level = checkpoint(rows.select(vector).mapInArrow(leaf, _MERGED))
    span = level.agg(F.max("node")).first()[0] + 1
    while span > 1:
        level = checkpoint(level.withColumn("node", F.floor(F.col("node") / fan)).groupBy("node").applyInArrow(merge, _MERGED))
        span = -(-span // fan)
    return np.frombuffer(level.first()["factor"]).reshape(-1, size)


def fit(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS, fan: int = FAN) -> tuple[DataFrame, Whitening | None, int]:
    """The rows that take part, what whitens them (None without rows), and the vectors' length."""
    ship(rows.sparkSession)
    rows, size = of_one_length(rows, vector)
    if not size:
        return rows, None, 0
    n, sums = totals(rows, vector, size)
    _, s, right = np.linalg.svd(_factor(rows, vector, size, n, sums, fan), full_matrices=True)
    s = np.concatenate([s, np.zeros(size - len(s))])  # fewer rows than dimensions
    s[s <= RANK * s[0]] = 0
    total = float((s**2).sum())
    shares = s**2 / total if total else np.full(size, np.nan)
    return rows, Whitening(n, sums, right[:components].T.copy(), s[:components] / np.sqrt(n), shares[:components]), size


def identity_error(rows: DataFrame, model: Whitening, size: int, vector: str = "embedding") -> float | None:
    """The largest entry of the covariance of the whitened rows minus the identity; None if no component has variance."""
    wanted = np.flatnonzero(model.deviations > 0)
    k = len(wanted)
    if not k:
        return None

    @task("whitening")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for batch in steps(batches, size):
            w = model.whiten(matrix(batch.column(0), size))[:, wanted]
            total += np.concatenate([w.sum(0), (w.T @ w).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    found = rows.select(vector).mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
    flat = np.array([r["x"] for r in sorted(found, key=lambda r: r["at"])]) / model.n
    mean, square = flat[:k], flat[k:].reshape(k, k)
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, model: Whitening | None, size: int, vector: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all by default) of the rows of ``fit`` with _tw_whitened, an entry a component, and _tw_deviation."""
    keep = keep if keep is not None else rows.columns
    schema = with_columns(rows.select(*keep).schema, "_tw_whitened array<double>, _tw_deviation decimal(38,0)")
    top = Decimal(10) ** 38

    @task("whitening")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, size or 1):
            values = matrix(batch.column(vector), size)
            w = model.whiten(values)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel(), from_pandas=True))
            exact = pa.array([x if x < top else None for x in map(Decimal, model.deviation(values))], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists, exact], names=[*keep, "_tw_whitened", "_tw_deviation"])

    return rows.select(*dict.fromkeys([*keep, vector])).mapInArrow(run, schema)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model, size = fit(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    error = identity_error(rows, model, size) if model else None
    shares = [None if np.isnan(x) else float(x) for x in model.explained] if model else []
    explained = F.array(*[F.lit(x).cast("double") for x in shares]).cast("array<double>")
    found = whiten(rows, model, size, keep=["vec_id"]).select("*", F.posexplode("_tw_whitened").alias("_at", "whitened"))
    exact = F.col("_tw_deviation")
    return found.select(
        "vec_id",
        (F.col("_at") + 1).cast("int").alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        exact.try_cast("long").alias("deviation"),
        "whitened",
        F.get(explained, F.col("_at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
        exact.alias("deviation_decimal"),
    )
