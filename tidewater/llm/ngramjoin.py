"""Operator 7: n-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles. Rows whose sets are equal are one class and are
joined through the class's least id; only classes meet each other:

1. 96 MinHash values of 16 bits; 24 bands of 4 of them give buckets. A pair of
   similarity 0.8 misses all bands with probability 3e-6.
2. Bucket mates are compared 16 values at a time. After each step a pair is dropped
   when the posterior probability (uniform prior) that its similarity reaches the
   threshold is below ``tolerance`` (BayesLSH, Satuluri and Parthasarathy, 2012).
3. Surviving pairs span clusters. Members of a cluster meet again, with their texts;
   what survives the same comparison is verified exactly on the shingle sets.

No pair is ever a row. Buckets and clusters are cut into tiles of bounded size (members
by a hash into blocks, one tile for every two blocks); a tile gives a row for each
member, with its number of links and the least id it reaches. So a group of many near
copies costs many tiles, not a large task or a large table.

Cases: null, empty and wordless texts are one class and are linked to each other only;
texts of one to four words have one shingle of all their words; repeated rows and ids
are linked like copies; rows without an id are linked like any others, and a class in which
none has one has no class_id; ids are numbers (other ids raise); an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blobs, checkpoint, drops, ship, slices, table, task, with_columns, words
from .decontaminate import _mix, grams
from .graphs import components

SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-5
BANDS, ROWS, STEP = 24, 4, 16
HASHES = BANDS * ROWS
TILE, TILE_SHINGLES = 256, 400_000
BROADCAST_BYTES = 32_000_000

_SEEDS = _mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_XOR, _MULTIPLY = _SEEDS[:HASHES], _SEEDS[HASHES:] | np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = []
drops.append(_powers.clear)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, kept in each worker."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 21)
        one = [np.full(size, x, np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
        for x in one:
            x[0] = 1
        _powers[:] = [np.cumprod(x) for x in one]
    return _powers[0], _powers[1]


def word_hashes(texts: list[list[bytes]]) -> np.ndarray:
    """A 64-bit hash of every word of every text, the same on any machine."""
    flat = b" ".join(b" ".join(x) for x in texts if x)
    if not flat:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(flat + b" ", np.uint8)
    up, down = _power_tables(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    return _mix((total[ends] - total[starts]) * down[starts])


def shingle_sets(texts: list[list[bytes]], n: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, in order of value."""
    hashes = word_hashes(texts)
    whole = grams(hashes, n)
    out, at = [], 0
    for x in texts:
        if len(x) >= n:
            out.append(np.unique(whole[at : at + len(x) - n + 1]))
        elif x:
            out.append(grams(hashes[at : at + len(x)], len(x)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += len(x)
    return out


def _half(shingles: np.ndarray, k: int) -> int:
    """Half k of a set's hash, as a signed number."""
    return int(_mix(shingles ^ np.uint64(k)).sum(dtype=np.uint64).astype(np.int64))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """96 MinHash values of 16 bits for each set; all zero for an empty one."""
    out = np.zeros((len(sets), HASHES), np.uint16)
    full = [i for i, x in enumerate(sets) if len(x)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        at = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]]).astype(np.int64)
        for k in range(HASHES):
            least = np.minimum.reduceat((flat ^ _XOR[k]) * _MULTIPLY[k], at)
            out[full, k] = (_mix(least) >> np.uint64(48)).astype(np.uint16)
    return out


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For 16, 32, ... compared values: the fewest matches with which a pair stays."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        below, m = 0.0, 0  # P(similarity >= threshold | m of n match) = P(Binomial(n + 1, threshold) <= m)
        while (below := below + comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)) < tolerance:
            m += 1
        out.append(m)
    return out


def _survivors(sig: np.ndarray, i: np.ndarray, j: np.ndarray, least: list[int]) -> np.ndarray:
    """Places of the pairs that no step drops."""
    alive, matches = np.arange(len(i)), np.zeros(len(i), np.int32)
    for k, need in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        matches = matches + (sig[i[alive], part] == sig[j[alive], part]).sum(1, dtype=np.int32)
        keep = matches >= need
        alive, matches = alive[keep], matches[keep]
    return alive


def _pairs(tile: np.ndarray, side: np.ndarray, mixed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of neighbours within tiles, in steps; where two blocks meet, only pairs across."""
    k = 1
    while True:
        i = np.flatnonzero(tile[:-k] == tile[k:]) if k < len(tile) else []
        if not len(i):
            return
        i = i[~mixed[i] | (side[i] != side[i + k])]
        yield i, i + k
        k += 1


def _reach(i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each member, the least id in its component."""
    label = ids.copy()
    while len(i):
        low = np.minimum(label[i], label[j])
        if (low == label[i]).all() and (low == label[j]).all():
            break
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
    return label


def _by_tile(batches: Iterator[pa.RecordBatch], limit: int, text: str | None = None) -> Iterator[pa.Table]:
    """Sorted batches anew, cut between tiles where ``limit`` rows (or bytes of text) are reached."""
    held: list[pa.RecordBatch] = []
    size = 0
    for whole in batches:
        for batch in slices(whole, text) if text else [whole]:
            if not batch.num_rows:
                continue
            tile = batch.column("tile").to_numpy()
            if held and size >= limit:
                cut = int(np.argmax(tile != held[-1].column("tile")[-1].as_py())) if tile[-1] != held[-1].column("tile")[-1].as_py() else len(tile)
                held.append(batch.slice(0, cut))
                if cut < len(tile):
                    yield pa.Table.from_batches(held)
                    held, size, batch = [], 0, batch.slice(cut)
                else:
                    continue
            held.append(batch)
            size += batch.column(text).nbytes if text else batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _sig_matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(blobs(column)), "<u2").reshape(-1, HASHES)


def _spread(rows: DataFrame, group: str, blocks) -> DataFrame:
    """Members dealt into the tiles of their group: tile, side (own block) and mixed (two blocks meet)."""
    own = rows.withColumn("_n", blocks.cast("int")).withColumn("side", F.pmod(F.xxhash64("node", group), F.col("_n")).cast("int"))
    other = own.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    tile = F.xxhash64(group, F.least("side", "_o"), F.greatest("side", "_o"))
    return other.withColumn("tile", tile).withColumn("mixed", F.col("side") != F.col("_o")).drop("_n", "_o")


def _candidates(tiles: DataFrame, least: list[int]) -> DataFrame:
    """Edges that span what survives the comparison within each tile."""

    @task("ngramjoin")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_tile(batches, 8192):
            sig, node = _sig_matrix(t.column("sig")), t.column("node").to_numpy()
            tile, side, mixed = (t.column(c).to_numpy() for c in ("tile", "side", "mixed"))
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j in _pairs(tile, side, mixed):
                alive = _survivors(sig, i, j, least)
                a.append(i[alive])
                b.append(j[alive])
            root = _reach(np.concatenate(a), np.concatenate(b), node)
            apart = root != node
            yield pa.RecordBatch.from_arrays([pa.array(node[apart]), pa.array(root[apart])], names=["u", "v"])

    return tiles.select("tile", "side", "mixed", "node", "sig").repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "u long, v long")


def _verified(tiles: DataFrame, least: list[int], threshold: float) -> DataFrame:
    """node, links (rows of other classes it is linked to in this tile) and the least node it reaches."""

    @task("ngramjoin")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_tile(batches, 2_000_000, "text"):
            sets = shingle_sets([words(x) for x in blobs(t.column("text"))])
            # A key stands for all equal rows: of those, one is kept.
            node, tile = t.column("node").to_numpy(), t.column("tile").to_numpy()
            own = [i for i, x in enumerate(sets) if _half(x, 1) == node[i]]
            one = sorted({(tile[i], node[i]): i for i in reversed(own)}.values())
            t, sets = t.take(pa.array(one, pa.int64())), [sets[i] for i in one]
            if not one:
                continue
            sig, node, copies = _sig_matrix(t.column("sig")), t.column("node").to_numpy(), t.column("copies").to_numpy()
            tile, side, mixed = (t.column(c).to_numpy() for c in ("tile", "side", "mixed"))
            sizes = np.array([len(x) for x in sets])
            _, code = np.unique(np.concatenate(sets), return_inverse=True)
            codes = np.split(code, np.cumsum(sizes)[:-1])
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j in _pairs(tile, side, mixed):
                alive = _survivors(sig, i, j, least)
                left.append(i[alive])
                right.append(j[alive])
            left, right = np.concatenate(left), np.concatenate(right)
            order = np.argsort(left, kind="stable")
            left, right = left[order], right[order]
            mark, linked = np.zeros(len(code) + 1, bool), np.zeros(len(left), bool)
            ends = np.flatnonzero(np.diff(np.concatenate([left, [-1]])))
            start = 0
            for end in ends + 1 if len(left) else []:
                i, partners = left[start], right[start:end]
                mark[codes[i]] = True
                for at in range(0, len(partners), 64):
                    some = partners[at : at + 64]
                    both = np.add.reduceat(mark[np.concatenate([codes[j] for j in some])].astype(np.int64), np.concatenate([[0], np.cumsum(sizes[some])[:-1]]))
                    linked[start + at : start + at + len(some)] = both >= threshold * (sizes[i] + sizes[some] - both) - 1e-9
                mark[codes[i]] = False
                start = end
            left, right = left[linked], right[linked]
            links = np.bincount(left, copies[right], len(node)) + np.bincount(right, copies[left], len(node))
            root = _reach(left, right, node)
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some])], names=["node", "links", "root"])

    chosen = tiles.select("tile", "side", "mixed", "node", "sig", "copies", "text").repartition("tile").sortWithinPartitions("tile")
    return chosen.mapInArrow(run, "node long, links long, root long")


def row_key(id_col: str, text_col: str, half: int = 0):
    """A 64-bit hash of a row's id and text; rows with equal ids and texts share it."""
    return F.xxhash64(F.lit(half), F.col(id_col).isNull(), F.col(id_col), F.col(text_col).isNull(), F.col(text_col))


def _signed(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """doc_id, the row's key, ``keep`` columns, the two halves of its set's hash, the number of shingles and the signature."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("key"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_tw_text"))
    own = rows.drop("_tw_text")
    schema = with_columns(own.schema, "a long, b long, shingles long, sig binary")

    @task("ngramjoin")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_tw_text"):
                sets = shingle_sets([words(x) for x in blobs(batch.column("_tw_text"))])
                sig = signatures(sets)
                halves = [[_half(x, k) for x in sets] for k in (1, 2)]
                columns = [*(batch.column(c) for c in names), *(pa.array(x, pa.int64()) for x in halves), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sig], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    names = own.columns
    return rows.mapInArrow(run, schema)


def join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE, keep: list[str] | None = None) -> DataFrame:
    """doc_id, class_id (the least id that links lead to) and n_links (other rows at or above the threshold) of every row.

    With ``keep``, also these columns, and class_key, which is the same for rows of a class only, whatever their ids.
    """
    ship(docs.sparkSession)
    least = least_matches(threshold, tolerance)
    signed = checkpoint(_signed(docs, id_col, text_col, keep or []))
    classes = signed.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.min("key").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value(F.struct("shingles", "sig")).alias("_x"))
    classes = checkpoint(classes.select(F.col("a").alias("node"), "b", "first", "rep", "copies", "_x.shingles", "_x.sig"))

    full = classes.where("shingles > 0")
    buckets = F.array(*[F.xxhash64(F.lit(k), F.substring("sig", 1 + 2 * ROWS * k, 2 * ROWS)) for k in range(BANDS)])
    bands = full.select("node", F.explode(buckets).alias("bucket"))
    crowded = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    mates = bands.join(crowded, "bucket").join(full.select("node", "sig"), "node")
    edges = _candidates(_spread(mates, "bucket", F.ceil(F.col("m") / tile)), least)

    clusters = components(edges).withColumnRenamed("root", "cluster")
    clusters = checkpoint(clusters.join(full.select("node", "first", "rep", "shingles", "copies", "sig"), "node"))
    sizes = clusters.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / tile), F.ceil(F.sum("shingles") / TILE_SHINGLES)).alias("blocks"))
    members = clusters.join(sizes, "cluster")
    held = clusters.count() * (7 * 8 + 2 * HASHES)
    texts = docs.select(row_key(id_col, text_col).alias("rep"), F.col(text_col).alias("text"))
    texts = texts.join(F.broadcast(members) if held <= BROADCAST_BYTES else members, "rep")
    links = checkpoint(_verified(_spread(texts, "cluster", F.col("blocks")), least, threshold))

    roots = components(links.select(F.col("node").alias("u"), F.col("root").alias("v"))).join(clusters.select("node", "first"), "node")
    named = roots.join(roots.groupBy("root").agg(F.min("first").alias("class_id")), "root").select("node", "root", "class_id")
    sums = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.select("node", "b", "first", "copies").join(sums.join(named, "node"), "node", "left")
    kept = [F.col(f"_k{i}").alias(c) for i, c in enumerate(keep or [])]
    own = signed.withColumnRenamed("a", "node").select("doc_id", "node", "b", *[f"_k{i}" for i in range(len(kept))])
    return own.join(known, ["node", "b"]).select(
        "doc_id",
        F.coalesce("class_id", "first").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        *kept,
        *([F.coalesce("root", "node").alias("class_key")] if keep else []),
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
