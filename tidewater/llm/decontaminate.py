"""Operator 1: benchmark decontamination by winnowing.

Every k-gram of words has a hash; of each w consecutive k-grams the last smallest one
is kept (Schleimer, Wilkerson and Aiken, 2003). With k = 5 and w = 6, texts that share
10 consecutive words share a kept k-gram at the same place within them. Items and
documents are winnowed alike, their fingerprints are joined, and every joined
fingerprint is extended: the windows of 10 item words that reach over it are looked up
and compared word by word. An item of fewer than 10 words is one window of its own
length; its windows are looked up at every place of a document.

The items are the build side of the join. They are read in blocks of at most
``block_bytes`` of text (one item at least), and every block meets all documents, so
what a task holds is bounded however many items there are. With one block, the
usual case, documents are read once and never shuffled.

Cases: null and empty texts have no words and are clean; null and wordless items have
no windows; items with equal texts each count; repeated documents each give a row;
without items every document is clean; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STEP_BYTES, blobs, ship, slices, table, task, with_columns, words

WINDOW, K = 10, 5
BLOCK_BYTES = 16_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive ids."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    base = _mix(ids.astype(np.uint64) + np.uint64(1))
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for i in range(n):
        out = out * _MIX + base[i : i + len(out)]
    return _mix(out)


def _grams_at(ids: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n ids from each place."""
    out = np.zeros(places.shape, np.uint64)
    for i in range(n):
        out = out * _MIX + _mix(ids[places + i].astype(np.uint64) + np.uint64(1))
    return _mix(out)


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Places of the last smallest of each w consecutive hashes; of all of them if there are fewer."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    w = min(w, len(hashes))
    n = len(hashes) - w + 1
    best, at = hashes[:n].copy(), np.zeros(n, np.int64)
    for i in range(1, w):
        new = hashes[i : i + n]
        smaller = new <= best
        best = np.where(smaller, new, best)
        at[smaller] = i
    return np.unique(at + np.arange(n))


class Index:
    """Windows and fingerprints of a block of items."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW, k: int = K):
        self.window, self.k, self.w = window, k, window - k + 1
        self.vocabulary: dict[bytes, int] = {}
        self.windows: dict[tuple[int, ...], list[str]] = {}  # ids of a window's words -> items that have it
        prints: list[np.ndarray] = []
        for item, text in items:
            ids = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words(text)]
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1 if ids else 0):
                at = self.windows.setdefault(tuple(ids[i : i + n]), [])
                if not at or at[-1] != item:
                    at.append(item)
            if n == window:
                h = grams(np.array(ids), k)
                prints.append(h[winnow(h, self.w)])
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        self.short = sorted({len(x) for x in self.windows if len(x) < window})
        by_length = {n: [x for x in self.windows if len(x) == n] for n in [*self.short, window]}
        self.hashes = {n: np.unique(np.concatenate([grams(np.array(x), n) for x in found])) if found else np.zeros(0, np.uint64) for n, found in by_length.items()}

    def _known(self, hashes: np.ndarray, among: np.ndarray) -> np.ndarray:
        if not len(among):
            return np.zeros(len(hashes), bool)
        at = np.searchsorted(among, hashes)
        return among[np.minimum(at, len(among) - 1)] == hashes

    def search(self, texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], list[str]]]:
        """For each text: the spans of words inside windows, joined and in order, and the items found."""
        lengths = np.array([len(x) for x in texts], np.int64)
        out: list[tuple[list[tuple[int, int]], list[str]]] = [([], []) for _ in texts]
        if not self.windows or not lengths.sum():
            return out
        get = self.vocabulary.get
        gap = self.window  # words that no item has, between texts
        starts = np.concatenate([[0], np.cumsum(lengths + gap)])
        ids = np.zeros(starts[-1], np.int64)
        for s, x in zip(starts, texts, strict=False):
            ids[s : s + len(x)] = [get(y, 0) for y in x]
        hits: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}

        def take(places: np.ndarray, n: int) -> None:
            for p, doc in zip(places.tolist(), (np.searchsorted(starts, places, "right") - 1).tolist(), strict=True):
                if found := self.windows.get(tuple(ids[p : p + n].tolist())):
                    hits.setdefault(doc, []).append((p - int(starts[doc]), p - int(starts[doc]) + n))
                    items.setdefault(doc, set()).update(found)

        if len(self.prints):
            # A window lies where ten words in a row are known; elsewhere nothing is winnowed.
            known = np.concatenate([[0], np.cumsum(ids > 0)])
            run = np.flatnonzero(known[self.window :] - known[: -self.window] == self.window)
            if len(run):
                near = _grams_at(ids, run[:, None] + np.arange(self.w), self.k)
                kept = np.unique(run + self.w - 1 - np.argmin(near[:, ::-1], axis=1))
                joined = kept[self._known(_grams_at(ids, kept, self.k), self.prints)]
                around = np.intersect1d((joined[:, None] - np.arange(self.w)).ravel(), run)
                take(around[self._known(_grams_at(ids, around, self.window), self.hashes[self.window])], self.window)
        for n in self.short:
            take(np.flatnonzero(self._known(grams(ids, n), self.hashes[n])), n)
        for doc, spans in hits.items():
            joined_spans: list[tuple[int, int]] = []
            for a, b in sorted(set(spans)):
                if joined_spans and a <= joined_spans[-1][1]:
                    joined_spans[-1] = (joined_spans[-1][0], max(b, joined_spans[-1][1]))
                else:
                    joined_spans.append((a, b))
            out[doc] = (joined_spans, sorted(items[doc]))
        return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, bytes | None]]]:
    """Items in blocks of bounded size, one block on the driver at a time."""
    block, held = [], 0
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).where(F.col(text_col).isNotNull())
    for item, text in rows.toLocalIterator():
        data = text.encode()
        if block and held + len(data) > block_bytes:
            yield block
            block, held = [], 0
        block.append((item or "", data))
        held += len(data)
    yield block


SPANS = "array<struct<start:int,end:int>>"


def _search(docs: DataFrame, index, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` columns with a digest of the text, n_words, spans and items; ``index`` is a broadcast Index."""
    schema = with_columns(docs.select(*keep).schema, f"_tw_digest string, _tw_n_words long, _tw_spans {SPANS}, _tw_items array<string>")
    wanted = list(dict.fromkeys([*keep, text_col]))

    @task("decontaminate")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col, STEP_BYTES):
                data = blobs(batch.column(text_col))
                texts = [words(x) for x in data]
                digests = pa.array([hashlib.sha256(x).hexdigest() if x is not None else None for x in data], pa.string())
                found = index.value.search(texts)
                spans = pa.array([[{"start": a, "end": b} for a, b in x[0]] for x in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                columns = [batch.column(c) for c in keep] + [digests, pa.array([len(x) for x in texts], pa.int64()), spans, pa.array([x[1] for x in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "_tw_digest", "_tw_n_words", "_tw_spans", "_tw_items"])

    return docs.select(*wanted).mapInArrow(run, schema)



def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    k: int = K,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    keep: list[str] | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``keep`` columns (all by default) with ``_tw_n_words``, ``_tw_spans`` (word offsets inside windows) and ``_tw_items``."""
    keep = keep if keep is not None else docs.columns
    context = ship(docs.sparkSession).sparkContext
    parts = [_search(docs, context.broadcast(Index(x, window, k)), text_col, keep) for x in _blocks(benchmark, item_col, item_text_col, block_bytes)]
    if len(parts) == 1:
        return parts[0].drop("_tw_digest")
    # Rows equal in every kept column and in text have equal results, so their number is all that tells them apart.
    union = parts[0]
    for part in parts[1:]:
        union = union.unionAll(part)
    merged = union.groupBy(*keep, "_tw_digest", "_tw_n_words").agg(
        F.count(F.lit(1)).alias("_tw_copies"), F.flatten(F.collect_list("_tw_spans")).alias("_tw_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_tw_items")))).alias("_tw_items")
    )
    ordered = F.array_sort(F.array_distinct("_tw_spans"))
    empty = F.lit(None).cast(SPANS)
    joined = F.aggregate(
        ordered,
        F.coalesce(empty, F.array().cast(SPANS)),
        lambda done, x: F.when(
            (F.size(done) > 0) & (x["start"] <= F.element_at(done, -1)["end"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(done, F.array(x))),
    )
    merged = merged.withColumn("_tw_spans", joined).withColumn("_tw_copy", F.explode(F.sequence(F.lit(1), (F.col("_tw_copies") / len(parts)).cast("int"))))
    return merged.select(*keep, "_tw_n_words", "_tw_spans", "_tw_items")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    hit = F.aggregate("_tw_spans", F.lit(0), lambda n, x: n + x["end"] - x["start"]).cast("long")
    return found.select(
        "doc_id",
        F.col("_tw_n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("_tw_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_tw_items"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
with d as (select doc_id, {_WORDS} as w from documents),
i as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark),
iw as (select item, w, least(len(w), {WINDOW}) as n from i where len(w) > 0),
win as (select distinct item, n, array_to_string(w[p:p + n - 1], ' ') as g
        from (select item, w, n, unnest(range(1, len(w) - n + 2)) as p from iw)),
sizes as (select distinct n from win),
dg as (select doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') as g
       from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from d, sizes where len(w) >= n)),
hits as (select doc_id, item, dg.n, p from dg join win on dg.n = win.n and dg.g = win.g),
hit_words as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from hits) group by 1),
hit_items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from hits) group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit_words using (doc_id) left join hit_items using (doc_id)
"""
