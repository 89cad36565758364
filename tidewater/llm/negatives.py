"""Operator 11: hard negatives by inner product, searched with a pivot table.

Vectors x of whole numbers are given one more entry, sqrt(M - |x|^2) with M the largest
squared length, and an anchor a gets 0 there; then |x' - a'|^2 = M + |a|^2 - 2 x.a, so inner
products are distances. Pivots are chosen farthest first from a sample of ``SAMPLE`` different rows.
The pivot table holds every row with its distances to all pivots, sorted by nearest pivot
and distance to it, and is written to the shared folder once. The triangle inequality over
these distances brackets the score of an anchor with a run of rows and then with each row;
what a bracket can't decide is computed exactly. So the search loses nothing (recall 1),
whatever the sample.

Anchors go out in blocks of ``BLOCK_BYTES``, each broadcast to one pass over the table for
positives and one for negatives. A task keeps the best few of each anchor and sends only
those, so a shuffle holds at most a few rows an anchor and task. The driver holds one block
of anchors and its positives.

Cases: rows with a null label, a null or empty vector, or null or non-finite entries take no
part, nor do vectors of another than the commonest length (the larger of two as common);
repeated rows count each, and another row is one with another id, so a repeated anchor gives
its rows again; a row without an id is no anchor and comes after all ids in ties (ids are
whole numbers below 2^63-1); an anchor without another row of its label, or without a
different label in range, gives no row; a positive score below 0 has nothing in range;
entries beyond 2^22, or lengths whose square passes 2^62, are an error; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, hashed_sample, ship, table, task
from .vectors import EXACT, matrix, of_one_length, scaled, steps

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 5, 80, 100
PIVOTS, SAMPLE = 16, 2048
#: Bytes of anchors that are broadcast at a time.
BLOCK_BYTES = 8_000_000
#: Rows and anchors that are compared in one step.
ROWS, ANCHORS = 512, 1024
#: Candidates held before all but the best of each key go.
HELD = 1 << 18
LIMIT = 1 << 30
NO_ID = (1 << 63) - 1
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


class Best:
    """The k best (higher score, then smaller id) of each key."""

    def __init__(self, keys: int, k: int):
        self.k, self.held = k, 0
        self.least = np.full(keys, np.iinfo(np.int64).min)  # what a score must reach
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(keys):
            self.parts.append((keys, scores, ids))
            self.held += len(keys)
            if self.held > HELD:
                self.cut()
                self.held = 0  # counts what came since, as the best themselves may be many

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, scores, ids = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*self.parts, strict=True) if self.parts else ((), (), ())))
        order = np.lexsort((ids, -scores, keys))
        keys, scores, ids = keys[order], scores[order], ids[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        place = np.arange(len(keys)) - np.repeat(first, np.diff(np.append(first, len(keys))))
        last = place == self.k - 1
        self.least[keys[last]] = scores[last]
        kept = place < self.k
        self.parts = [(keys[kept], scores[kept], ids[kept])]
        return self.parts[0]


class Anchors:
    """A block of anchors with their distances to the pivots."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, top: int):
        self.ids, self.labels, self.vectors, self.top = ids, labels, vectors, top
        self.both = top + (vectors * vectors).sum(1).astype(np.float64)  # M + |a|^2
        self.far = np.sqrt(np.maximum(self.both[:, None] - 2.0 * (vectors @ pivots.T), 0))
        self.slack = 1e-9 * self.both + 1

    def run_bounds(self, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score of each anchor with any row whose distances to the pivots are between ``near`` and ``far``."""
        least = np.maximum(np.maximum(self.far - far, near - self.far), 0).max(1)
        most = (self.far + far).min(1)
        return (self.both - most**2) / 2 - self.slack, (self.both - least**2) / 2 + self.slack

    def bounds(self, chosen: np.ndarray, distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score of each chosen anchor with each row."""
        least, most = np.zeros((len(chosen), len(distances))), np.full((len(chosen), len(distances)), np.inf)
        for j in range(distances.shape[1]):
            a, x = self.far[chosen, j, None], distances[None, :, j]
            np.maximum(least, np.abs(a - x), out=least)
            np.minimum(most, a + x, out=most)
        both, slack = self.both[chosen, None], self.slack[chosen, None]
        return (both - most**2) / 2 - slack, (both - least**2) / 2 + slack

    def scores(self, chosen: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Exact inner products."""
        if self.top < EXACT:  # no partial sum passes it, so doubles are exact
            return (self.vectors[chosen].astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
        return self.vectors[chosen] @ vectors.T


def _survivors(block: Anchors, chosen: np.ndarray, vectors: np.ndarray, distances: np.ndarray, low: np.ndarray, high: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchors, rows, scores) of pairs whose exact score is from ``low`` to ``high``, found through the brackets; low and high are an anchor's."""
    near, far = distances.min(0), distances.max(0)
    least, most = block.run_bounds(near, far)
    reach = most[chosen] >= low[chosen]
    if high is not None:
        reach &= least[chosen] <= high[chosen]
    chosen = chosen[reach]
    for at in range(0, len(chosen), ANCHORS):
        part = chosen[at : at + ANCHORS]
        least, most = block.bounds(part, distances)
        open_ = most >= low[part, None]
        if high is not None:
            open_ &= least <= high[part, None]
        some, rows = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
        if not len(some):
            continue
        exact = block.scores(part[some], vectors[rows])
        found = open_[np.ix_(some, rows)] & (exact >= low[part[some], None])
        if high is not None:
            found &= exact <= high[part[some], None]
        i, j = np.nonzero(found)
        yield part[some][i], rows[j], exact[i, j]


def _unpacked(batch: pa.RecordBatch, size: int, pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels, vectors and distances of rows of the pivot table."""
    ids = np.asarray(batch.column("id").fill_null(NO_ID), np.int64)
    vectors = np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.int32).reshape(-1, size).astype(np.int64)
    distances = np.frombuffer(b"".join(batch.column("distances").to_pylist()), np.float64).reshape(-1, pivots)
    return ids, np.asarray(batch.column("label"), np.int64), vectors, distances


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def choose_pivots(sample: np.ndarray, top: int, pivots: int = PIVOTS) -> np.ndarray:
    """Rows of the sample, each the farthest from those before it."""
    squares = (sample * sample).sum(1)
    rest = np.sqrt(np.maximum(top - squares, 0).astype(np.float64))
    chosen = [int(np.argmax(squares))]
    distance = np.full(len(sample), np.inf)
    while len(chosen) < min(pivots, len(sample)):
        x = chosen[-1]
        distance = np.minimum(distance, 2.0 * (top - sample @ sample[x] - rest * rest[x]))
        chosen.append(int(np.argmax(distance)))
    return sample[chosen]


class PivotTable:
    """Rows with their distances to the pivots, in the shared folder."""

    def __init__(self, rows: DataFrame, size: int, pivots: np.ndarray, top: int):
        self.rows, self.size, self.pivots, self.top = rows, size, pivots, top


def index(rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", pivots: int = PIVOTS, sample: int = SAMPLE) -> PivotTable | None:
    """The pivot table of all rows that take part; None without any. ``anchor`` says of a row whether it is an anchor."""
    ship(rows.sparkSession)
    rows, size = of_one_length(rows.where(F.col(label_col).isNotNull()), vector_col)
    if not size:
        return None
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))

    @task("negatives")
    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = 0
        for batch in steps(batches, size):
            x = scaled(matrix(batch.column(0), size), SCALE, LIMIT)
            if (x.astype(np.float64) ** 2).sum(1).max() >= 1 << 62:
                raise ValueError("a vector is too long for exact inner products")
            top = max(top, int((x * x).sum(1).max()))
        yield pa.RecordBatch.from_arrays([pa.array([top], pa.int64())], names=["top"])

    top = rows.select("vector").mapInArrow(longest, "top long").agg(F.max("top")).first()[0]
    seen = hashed_sample(rows.select("vector"), "vector", sample).collect()
    chosen = choose_pivots(scaled(np.array([r["vector"] for r in seen], np.float64), SCALE, LIMIT), top, pivots)
    rest = np.sqrt((top - (chosen * chosen).sum(1)).astype(np.float64))

    @task("negatives")
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, size):
            x = scaled(matrix(batch.column("vector"), size), SCALE, LIMIT)
            own = np.sqrt((top - (x * x).sum(1)).astype(np.float64))
            far = np.sqrt(np.maximum(2.0 * (top - (x @ chosen.T) - own[:, None] * rest), 0))
            cell = far.argmin(1)
            packed = [pa.array([r.tobytes() for r in y], pa.binary()) for y in (x.astype(np.int32), far)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), batch.column("anchor"), *packed, pa.array(cell, pa.int32()), pa.array(far[np.arange(len(far)), cell], pa.float64())],
                names=["id", "label", "anchor", "vector", "distances", "cell", "near"],
            )

    placed = rows.mapInArrow(place, "id long, label long, anchor boolean, vector binary, distances binary, cell int, near double")
    # Rows of one vector, be they a third of all, are dealt by their ids.
    held = checkpoint(placed.repartitionByRange("cell", "near", F.xxhash64("id")).sortWithinPartitions("cell", "near"))
    return PivotTable(held, size, chosen, top)


def _blocks(found: PivotTable, block_bytes: int) -> Iterator[Anchors]:
    anchors = found.rows.where("anchor").select("id", "label", "vector")
    n = -(-anchors.count() * (8 * (found.size + len(found.pivots) + 2 * POSITIVES) + 32) // block_bytes)
    for b in range(n):
        # By a number of the row, not its id, so that repeated anchors don't meet in one block.
        rows = sorted((r["id"], r["label"], bytes(r["vector"])) for r in anchors.where(F.pmod(F.monotonically_increasing_id(), F.lit(n)) == b).collect())
        if rows:
            ids, labels, vectors = zip(*rows, strict=True)
            yield Anchors(np.array(ids, np.int64), np.array(labels, np.int64), np.frombuffer(b"".join(vectors), np.int32).reshape(-1, found.size).astype(np.int64), found.pivots, found.top)


def _positives(found: PivotTable, block: Anchors, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, scores, which there are) of the k best other rows of each anchor's label."""
    shared = found.rows.sparkSession.sparkContext.broadcast(block)
    size, pivots = found.size, len(found.pivots)

    @task("negatives")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, of_label = shared.value, {}
        best = Best(len(block.ids), k)
        for batch in _runs(batches):
            ids, labels, vectors, distances = _unpacked(batch, size, pivots)
            for label in np.unique(labels).tolist():
                if label not in of_label:
                    of_label[label] = np.flatnonzero(block.labels == label)
                rows = np.flatnonzero(labels == label)
                for a, r, s in _survivors(block, of_label[label], vectors[rows], distances[rows], best.least, None):
                    other = block.ids[a] != ids[rows[r]]
                    best.add(a[other], s[other], ids[rows[r[other]]])
            if best.parts and best.held:
                best.cut()
        keys, scores, ids = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, scores, ids)], names=["key", "score", "id"])

    parts = found.rows.select("id", "label", "vector", "distances").mapInArrow(run, "key long, score long, id long")
    order = W.partitionBy("key").orderBy(F.desc("score"), "id")
    rows = parts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).collect()
    ids, scores, real = np.zeros((len(block.ids), k), np.int64), np.zeros((len(block.ids), k), np.int64), np.zeros((len(block.ids), k), bool)
    for r in rows:
        ids[r["key"], r["place"] - 1], scores[r["key"], r["place"] - 1], real[r["key"], r["place"] - 1] = r["id"], r["score"], True
    return ids, scores, real


def _negatives(found: PivotTable, block: Anchors, positives: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, low: int, high: int) -> DataFrame:
    pos_ids, pos_scores, real = positives
    shared = found.rows.sparkSession.sparkContext.broadcast((block, pos_ids, pos_scores, real))
    size, pivots = found.size, len(found.pivots)

    @task("negatives")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, pos_ids, pos_scores, real = shared.value
        n, m = pos_scores.shape
        none = np.iinfo(np.int64)
        lows, highs = -(-low * pos_scores // 100), high * pos_scores // 100
        lows, highs = np.where(real & (lows <= highs), lows, none.max), np.where(real & (lows <= highs), highs, none.min)
        best = Best(n * m, k)
        reach, top = lows.min(1), highs.max(1)
        for batch in _runs(batches):
            ids, labels, vectors, distances = _unpacked(batch, size, pivots)
            for a, r, s in _survivors(block, np.flatnonzero(reach <= top), vectors, distances, reach, top):
                other = block.labels[a] != labels[r]
                a, r, s = a[other], r[other], s[other]
                for j in range(m):
                    fits = (s >= lows[a, j]) & (s <= highs[a, j]) & (s >= best.least[a * m + j])
                    best.add(a[fits] * m + j, s[fits], ids[r[fits]])
            if best.parts and best.held:
                best.cut()
                reach = np.maximum(lows, best.least.reshape(n, m)).min(1)
        keys, scores, ids = best.cut()
        a, j = keys // m, keys % m
        columns = [keys, block.ids[a], pos_ids[a, j], ids, pos_scores[a, j], scores]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["key", "anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    parts = found.rows.select("id", "label", "vector", "distances").mapInArrow(run, "key long, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    order = W.partitionBy("key").orderBy(F.desc("negative_score"), "negative_id")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(found: PivotTable, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block_bytes: int = BLOCK_BYTES) -> DataFrame | None:
    """Of each anchor and positive the best rows of another label whose score is from ``low`` to ``high`` hundredths of the positive's; None without anchors."""
    out = None
    for block in _blocks(found, block_bytes):
        part = checkpoint(_negatives(found, block, _positives(found, block, positives), negatives, low, high))
        out = part if out is None else out.unionAll(part)
    return out


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))
    found = index(rows, vec_id % 100 == 0)
    out = mine(found) if found else None
    if out is None:
        return spark.createDataFrame([], RESULT)

    def known(name: str) -> Column:
        return F.when(F.col(name) != NO_ID, F.col(name)).alias(name)

    return out.select("anchor_id", known("positive_id"), F.col("rank").cast("int").alias("rank"), known("negative_id"), "positive_score", "negative_score")


ORACLE_SQL = f"""
with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                  [floor({SCALE} * cast(x as double)) for x in embedding] as q
           from embeddings where label is not null and len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_dot_product(a.q, b.q) as bigint) as score
      from r a join r b on a.vec_id % 100 = 0 and a.vec_id is distinct from b.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
      qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= {POSITIVES}),
n as (select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as integer) as rank,
             vec_id as negative_id, positive_score, score as negative_score
      from p join s using (anchor_id) where not same and {LOW} * positive_score <= 100 * score and 100 * score <= {HIGH} * positive_score)
select * from n where rank <= {NEGATIVES}
"""
