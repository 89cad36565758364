"""Operator 3: toxic spans by a linear-chain conditional random field.

Labels are given for documents. Over the distinct texts of all labelled training rows,
words and word beginnings are counted in toxic and in clean texts; those that stand out
(``seeds``) label the tokens of toxic documents, and no token of a clean one is toxic.
A seed is in a thousandth of the toxic texts, and in three, at least. Seeds stay a
distributed table: those of each sampled text are joined to it, and only they travel.
A two-label CRF (hashed features of the word, its beginnings and ending and its
neighbours; transitions) is fitted on windows of a bounded sample: at most ``sample``
toxic and as many clean texts, the first by a hash of the id, and at most
``windows`` windows of ``span`` tokens of each. Every whole text is then tagged:
forward-backward gives each token's marginal. The logarithms of the expected number of
toxic tokens and of the length give the document's score by a logistic curve, fitted on the sample's whole texts
with weights that restore the shares of both labels.

Forward-backward runs over many documents at once as a scan of 2 x 2 matrices in
parallel lanes; a text of any length costs time in proportion and no Python loop over
its tokens.

Cases: null, empty and wordless texts score 0; equal texts score alike; labels that are
null are ignored, a document labelled twice and copies with different labels are toxic
if either label says so; copies count once; with no toxic or no clean training row every
score is 0; repeated rows are scored each; rows without an id are scored, have no label
and are not held out; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BYTES, blobs, checkpoint, ship, slices, table, task, trim, with_columns

THRESHOLD, SAMPLE, WINDOWS, SPAN = 0.7, 4000, 2, 48
#: The toxic texts that hold a seed: so many, and this share of them, at least.
SUPPORT, SUPPORT_SHARE = 3, 0.001
HASH_BITS = 18
#: Windows that go through a gradient step together, on the driver.
FIT_WINDOWS = 1024
#: Words kept in each Python worker, and bytes of text tagged at a time.
CACHE, TAG_BYTES = 100_000, 500_000
#: Marginals below this are the background of long texts and don't count.
SUSPICIOUS = 0.1
BROADCAST_BYTES = 32_000_000
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_NONE = b""


def tokens(text: bytes | None) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def _features(word: bytes) -> list[int]:
    """Hashed features of a word in its own place."""
    n = len(word)
    found = [b"w" + word, b"z" + word[-3:], b"n%d" % min(n, 12)]
    found += [b"p%d" % k + word[:k] for k in (4, 5, 6) if n > k]
    return [zlib.crc32(x) & ((1 << HASH_BITS) - 1) for x in found]


def _beside(word: bytes, side: bytes) -> int:
    return zlib.crc32(side + word) & ((1 << HASH_BITS) - 1)


class Tagger:
    """Weights, transitions (as factors) and the log odds of the first label."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray, first: float):
        self.weights, self.transitions, self.first = weights, transitions, first
        self.curve = np.array([-4.0, 6.0, 0.0])

    @staticmethod
    def evidence(logits: np.ndarray) -> tuple[float, float, float]:
        """What the curve takes: a constant and the logs of the expected toxic tokens and of the length."""
        p = 1 / (1 + np.exp(-np.clip(logits, -40, 40)))
        return 1.0, float(np.log1p(p[p >= SUSPICIOUS].sum())), float(np.log1p(len(logits)))

    def document(self, logits: np.ndarray) -> float:
        if not len(logits):
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.curve, self.evidence(logits)), -40, 40))))

    def calibrate(self, rows: list[tuple[float, float, float, int]], shares: dict[int, float]) -> None:
        """Fit the curve by Newton steps; a row is evidence and label, weighted by its label's share."""
        x, y = np.array([r[:3] for r in rows]), np.array([r[3] for r in rows], float)
        weight = np.array([shares[int(v)] for v in y]) * len(y)
        weight = weight / np.array([max(1, (y == v).sum()) for v in y])
        curve, ridge = np.zeros(3), np.diag([0.01, 0.01, 1.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ curve, -40, 40)))
            slope = x.T @ (weight * (y - p)) - ridge @ curve
            curve = curve + np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, slope)
        if np.isfinite(curve).all() and curve[1] > 0:
            self.curve = curve

    def _learn(self, words: list[bytes], cache: dict[bytes, tuple[float, float, float]]) -> None:
        w = self.weights
        for x in words:
            cache[x] = (float(sum(w[i] for i in _features(x))), float(w[_beside(x, b"<")]), float(w[_beside(x, b">")]))

    def logits(self, texts: list[list[bytes]], cache: dict) -> list[np.ndarray]:
        """The log odds of each token's marginal."""
        lengths = [len(x) for x in texts]
        total = sum(lengths)
        if not total:
            return [np.zeros(0) for _ in texts]
        if len(cache) > CACHE:
            cache.clear()
        self._learn([x for x in {y for t in texts for y in t} | {_NONE} if x not in cache], cache)
        starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        first = np.zeros(total, bool)
        last = np.zeros(total, bool)
        full = np.array(lengths) > 0
        first[starts[:-1][full]] = True
        last[starts[1:][full] - 1] = True
        values = np.array([cache[y] for t in texts for y in t])
        none = cache[_NONE]
        before = np.concatenate([[none[1]], values[:-1, 1]])
        after = np.concatenate([values[1:, 2], [none[2]]])
        d = values[:, 0] + np.where(first, none[1], before) + np.where(last, none[2], after)
        forward = _scan(d, first, self.first, self.transitions)
        backward = _scan(d[::-1], last[::-1], 0.0, self.transitions.T)[::-1]
        out = forward + backward - d
        return [out[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]


def _scan(d: np.ndarray, reset: np.ndarray, init: float, t: np.ndarray, lanes: int = 1024) -> np.ndarray:
    """x[i] = d[i] + log((t01 + t11 e^x[i-1]) / (t00 + t10 e^x[i-1])), or d[i] + init at a reset."""
    n = len(d)
    steps = -(-n // lanes)
    lanes = -(-n // steps)
    pad = steps * lanes - n
    e = np.exp(np.clip(np.concatenate([d, np.zeros(pad)]), -40, 40)).reshape(lanes, steps).T
    r = np.concatenate([reset, np.ones(pad, bool)]).reshape(lanes, steps).T
    s = float(np.exp(init))
    # The matrix of each lane, from what enters it to what leaves it.
    a, b, c, g = np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)  # rows (a b), (c g)
    for i in range(steps):
        a, b, c, g = t[0, 0] * a + t[1, 0] * c, t[0, 0] * b + t[1, 0] * g, e[i] * (t[0, 1] * a + t[1, 1] * c), e[i] * (t[0, 1] * b + t[1, 1] * g)
        if r[i].any():
            k = r[i]
            a, b, c, g = np.where(k, 1, a), np.where(k, 1, b), np.where(k, s * e[i], c), np.where(k, s * e[i], g)
        top = a + b + c + g
        a, b, c, g = a / top, b / top, c / top, g / top
    enter = np.zeros((2, lanes))
    u0, u1 = 1.0, 1.0
    for i in range(lanes):
        enter[:, i] = u0, u1
        u0, u1 = a[i] * u0 + b[i] * u1, c[i] * u0 + g[i] * u1
        top = u0 + u1
        u0, u1 = u0 / top, u1 / top
    out = np.empty((steps, lanes))
    u0, u1 = enter
    for i in range(steps):
        v0, v1 = t[0, 0] * u0 + t[1, 0] * u1, e[i] * (t[0, 1] * u0 + t[1, 1] * u1)
        v0, v1 = np.where(r[i], 1, v0), np.where(r[i], s * e[i], v1)
        top = v0 + v1
        u0, u1 = v0 / top, v1 / top
        out[i] = np.log(np.maximum(u1, 1e-300)) - np.log(np.maximum(u0, 1e-300))
    return out.T.ravel()[:n]


def fit(windows: Iterable[tuple[list[bytes], Sequence[int]]], rounds: int = 60, penalty: float = 0.02, rate: float = 0.5) -> Tagger:
    """Maximise the penalised likelihood of the windows' labels by adaptive gradient steps.

    Words are held once, tokens as places in their list, and ``FIT_WINDOWS`` windows go through a
    gradient step at a time, so the driver holds few arrays of the size of the sample.
    """
    place = {_NONE: 0}
    flat_ids, flat_labels, sizes = array("i"), array("b"), array("i")
    for words, marks in windows:
        if words:
            flat_ids.extend(place.setdefault(x, len(place)) for x in words)
            flat_labels.extend(marks)
            sizes.append(len(words))
    n, length = len(sizes), max(sizes, default=1)
    real = np.arange(length) < np.array(sizes, np.int32)[:, None]
    ids, labels = np.zeros((n, length + 2), np.int32), np.zeros((n, length), np.int8)
    ids[:, 1:-1][real], labels[real] = flat_ids, flat_labels
    del flat_ids, flat_labels
    # Each distinct word has its features once.
    own, each = array("i"), array("i")
    for x in place:
        found = _features(x)
        own.extend(found)
        each.append(len(found))
    word = np.repeat(np.arange(len(place), dtype=np.int32), each)
    feature = np.concatenate([np.array(own, np.int32), np.array([_beside(x, b"<") for x in place], np.int32), np.array([_beside(x, b">") for x in place], np.int32)])
    used, feature = np.unique(feature, return_inverse=True)
    feature, left, right = np.split(feature, [len(word), len(word) + len(place)])
    many, steps = len(place), [slice(at, at + FIT_WINDOWS) for at in range(0, n, FIT_WINDOWS)]
    del place, own, each
    here, before, after = (ids[:, at : at + length] for at in (1, 0, 2))
    both = real[:, 1:]
    l0, l1 = labels[:, :-1] > 0, labels[:, 1:] > 0
    seen = np.array([[(~l0 & ~l1 & both).sum(), (~l0 & l1 & both).sum()], [(l0 & ~l1 & both).sum(), (l0 & l1 & both).sum()]], float)
    del l0, l1
    w, w2 = np.zeros(len(used)), np.full(len(used), 1e-6)
    t, t2 = np.array([[0.0, -1.0], [0.0, 0.0]]), np.full((2, 2), 1e-6)
    s, s2 = -2.0, 1e-6

    def onward(x, f):
        e = np.exp(np.clip(x, -40, 40))
        return np.log(f[0, 1] + f[1, 1] * e) - np.log(f[0, 0] + f[1, 0] * e)

    for _ in range(rounds):
        score, f = np.bincount(word, w[feature], many), np.exp(t)
        aside = w[left], w[right]
        errors = [np.zeros(many) for _ in range(3)]  # of a word in its own place, before and after another
        pairs, grad_s = np.zeros((2, 2)), 0.0
        for some in steps:
            own_real = real[some]
            d = score[here[some]] + aside[0][before[some]] + aside[1][after[some]]
            alpha, beta = np.zeros(d.shape), np.zeros(d.shape)  # log odds
            alpha[:, 0] = d[:, 0] + s
            for i in range(1, length):
                alpha[:, i] = d[:, i] + onward(alpha[:, i - 1], f)
            for i in range(length - 1, 0, -1):
                beta[:, i - 1] = np.where(own_real[:, i], onward(d[:, i] + beta[:, i], f.T), 0)
            p = np.where(own_real, 1 / (1 + np.exp(-np.clip(alpha + beta, -40, 40))), 0)
            error = np.where(own_real, labels[some] - p, 0)
            for total, of in zip(errors, (here, before, after), strict=True):
                total += np.bincount(of[some].ravel(), error.ravel(), many)
            x, y = np.exp(np.clip(alpha[:, :-1], -40, 40)), np.exp(np.clip(d[:, 1:] + beta[:, 1:], -40, 40))
            pair = np.array([[np.full_like(x, f[0, 0]), f[0, 1] * y], [f[1, 0] * x, f[1, 1] * x * y]])
            pairs += (pair / pair.sum((0, 1)) * both[some]).sum((2, 3))
            grad_s += error[:, 0].sum()
        grad = np.bincount(feature, errors[0][word], len(used)) - penalty * w
        for side, total in zip((left, right), errors[1:], strict=True):
            grad += np.bincount(side, total, len(used))
        grad_t = seen - pairs - penalty * t
        w2 += grad**2
        t2 += grad_t**2
        s2 += grad_s**2
        w += rate * grad / np.sqrt(w2)
        t += rate * grad_t / np.sqrt(t2)
        s += rate * grad_s / np.sqrt(s2)
    weights = np.zeros(1 << HASH_BITS, np.float32)
    weights[used] = w
    return Tagger(weights, np.exp(t), float(s))


def _counts(rows: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """Documents of either label that hold each word (w) or beginning (p); summed in each task first."""

    @task("toxicity")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[bytes, int]] = [{}, {}]

        def flush() -> pa.RecordBatch:
            keys = list(held[0].keys() | held[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(pa.array([x.get(k, 0) for k in keys], pa.int64()) for x in held)], names=["feature", "clean", "toxic"])
            held[0].clear(), held[1].clear()
            return out

        for batch in batches:
            for text, label in zip(blobs(batch.column(text_col)), batch.column(label_col).to_pylist(), strict=True):
                own = held[1 if label else 0]
                found = set(tokens(text))
                for x in found:
                    own[b"w" + x] = own.get(b"w" + x, 0) + 1
                for x in {x[:5] for x in found if len(x) > 5}:
                    own[b"p" + x] = own.get(b"p" + x, 0) + 1
                if len(held[0]) + len(held[1]) > 400_000:
                    yield flush()
        yield flush()

    return rows.select(text_col, label_col).mapInArrow(run, "feature binary, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _features_of(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The words and beginnings that each text holds, once each."""

    @task("toxicity")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col, TAG_BYTES):
                ids, found = [], []
                for i, text in enumerate(blobs(batch.column(text_col))):
                    own = set(tokens(text))
                    own = [b"w" + x for x in own] + [b"p" + x for x in {x[:5] for x in own if len(x) > 5}]
                    ids += [i] * len(own)
                    found += own
                yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(ids, pa.int32())), pa.array(found, pa.binary())], names=[id_col, "feature"])

    return rows.select(id_col, text_col).mapInArrow(run, with_columns(rows.select(id_col).schema, "feature binary"))


def _mark(words: list[bytes], seeds: set[bytes]) -> list[int]:
    return [int(b"w" + x in seeds or len(x) > 5 and b"p" + x[:5] in seeds) for x in words]


def _windows(rows: DataFrame, id_col: str, text_col: str, label_col: str, seeds_col: str, windows: int, span: int) -> DataFrame:
    @task("toxicity")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_words, out_marks = [], []
            columns = batch.column(id_col).to_pylist(), blobs(batch.column(text_col)), batch.column(label_col).to_pylist(), batch.column(seeds_col).to_pylist()
            for key, text, label, seeds in zip(*columns, strict=True):
                words = tokens(text)
                marks = _mark(words, set(seeds or ())) if label else [0] * len(words)
                places = [i for i, x in enumerate(marks) if x] if label else []
                if label and not places:
                    continue  # nothing says which of its tokens are toxic
                last = max(1, len(words) - span)
                for k in range(windows):
                    h = zlib.crc32(f"{key} {k}".encode())
                    at = max(0, places[h % len(places)] - h // 7 % span) if places else h % last
                    if words:
                        out_words.append(b" ".join(words[at : at + span]))
                        out_marks.append(bytes(marks[at : at + span]))
            yield pa.RecordBatch.from_arrays([pa.array(out_words, pa.binary()), pa.array(out_marks, pa.binary())], names=["words", "marks"])

    return rows.select(id_col, text_col, label_col, seeds_col).mapInArrow(run, "words binary, marks binary")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, windows: int = WINDOWS, span: int = SPAN) -> Tagger | None:
    """A tagger from labelled rows; None if either label is missing."""
    ship(docs.sparkSession)
    labels = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_tw_id")).agg(F.max(F.col(label_col).cast("int")).alias("_tw_label"))
    texts = docs.select(F.col(id_col).alias("_tw_id"), F.col(text_col).alias("_tw_text"))

    def labelled(keys: DataFrame) -> DataFrame:
        held = keys.agg(F.coalesce(F.sum(F.octet_length(F.col("_tw_id").cast("string")) + 16), F.lit(0))).first()[0]
        return texts.join(F.broadcast(keys) if held <= BROADCAST_BYTES else keys, "_tw_id")

    # Of each text one id, so that copies don't make their words stand out.
    same = [F.xxhash64(F.lit(k), "_tw_text") for k in (0, 1)]
    one = labelled(labels).select("_tw_id", "_tw_label", *[x.alias(f"_tw_h{k}") for k, x in enumerate(same)]).groupBy("_tw_h0", "_tw_h1").agg(F.min("_tw_id").alias("_tw_id"), F.max("_tw_label").alias("_tw_label"))
    labels = checkpoint(one.groupBy("_tw_id").agg(F.max("_tw_label").alias("_tw_label")))
    by = {r["_tw_label"]: r["count"] for r in labels.groupBy("_tw_label").count().collect()}
    toxic, clean = sum(n for k, n in by.items() if k > 0), by.get(0, 0)
    if not toxic or not clean:
        return None
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    support = max(SUPPORT, ceil(SUPPORT_SHARE * toxic))
    standing = checkpoint(_counts(labelled(labels), "_tw_text", "_tw_label").where((F.col("toxic") >= support) & (odds >= 3)).select("feature"))
    chosen = [labels.where((F.col("_tw_label") > 0) == F.lit(x)).orderBy(F.xxhash64("_tw_id"), "_tw_id").limit(sample) for x in (True, False)]
    texts = checkpoint(texts.join(F.broadcast(chosen[0].unionAll(chosen[1])), "_tw_id"))  # at most ``sample`` of either label
    seeds = _features_of(texts.where("_tw_label > 0"), "_tw_id", "_tw_text").join(standing, "feature").groupBy("_tw_id").agg(F.collect_set("feature").alias("_tw_seeds"))
    found = _windows(texts.join(seeds, "_tw_id", "left"), "_tw_id", "_tw_text", "_tw_label", "_tw_seeds", windows, span).collect()
    found = sorted((bytes(r["words"]), bytes(r["marks"])) for r in found)
    if not any(1 in m for _, m in found):
        return None
    tagger = fit((w.split(), m) for w, m in found)
    del found
    trim()  # the driver goes on without what the fit took
    rows = _evidence(texts, tagger, "_tw_text", "_tw_label").collect()
    tagger.calibrate(sorted((r["one"], r["hits"], r["length"], r["label"]) for r in rows), {0: clean / (clean + toxic), 1: toxic / (clean + toxic)})
    return tagger


def _evidence(rows: DataFrame, tagger: Tagger, text_col: str, label_col: str) -> DataFrame:
    """What the curve is fitted on, for each row of the bounded sample that has a word."""
    shared = rows.sparkSession.sparkContext.broadcast(tagger)

    @task("toxicity")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = shared.value, {}
        for whole in batches:
            for batch in slices(whole, text_col, TAG_BYTES):
                logits = model.logits([tokens(x) for x in blobs(batch.column(text_col))], cache)
                found = [(*model.evidence(x), int(y > 0)) for x, y in zip(logits, batch.column(label_col).to_pylist(), strict=True) if len(x)]
                columns = [[x[i] for x in found] for i in range(4)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.float64()) for c in columns[:3]), pa.array(columns[3], pa.int32())], names=["one", "hits", "length", "label"])

    return rows.select(text_col, label_col).mapInArrow(run, "one double, hits double, length double, label int")


def score(docs: DataFrame, tagger: Tagger | None, text_col: str = "text", keep: list[str] | None = None, where: float | None = None) -> DataFrame:
    """The ``keep`` columns (all by default) with _tw_score and _tw_spans, character offsets of toxic tokens; rows from ``where`` on are left out."""
    keep = keep if keep is not None else docs.columns
    wanted = list(dict.fromkeys([*keep, text_col]))
    shared = ship(docs.sparkSession).sparkContext.broadcast(tagger)
    schema = with_columns(docs.select(*keep).schema, "_tw_score double, _tw_spans array<struct<start:int,end:int>>")

    @task("toxicity")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = shared.value, {}
        for whole in batches:
            for batch in slices(whole, text_col, TAG_BYTES):
                data = blobs(batch.column(text_col))
                scores, spans = [], []
                logits = model.logits([tokens(x) for x in data], cache) if model else [np.zeros(0)] * len(data)
                for text, x in zip(data, logits, strict=True):
                    scores.append(model.document(x) if model else 0.0)
                    toxic = set(np.flatnonzero(x >= 0).tolist())
                    found, at, chars = [], 0, 0  # the bytes that are counted, and their characters
                    if toxic:
                        for i, m in enumerate(_WORD.finditer(text)):
                            if i in toxic:
                                start = chars + len(text[at : m.start()].decode("utf-8", "replace"))
                                at, chars = m.end(), start + len(m[0].decode("utf-8", "replace"))
                                found.append({"start": start, "end": chars})
                    spans.append(found)
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=[*keep, "_tw_score", "_tw_spans"])
                yield out if where is None else out.filter(pa.array([s < where for s in scores]))

    return docs.select(*wanted).mapInArrow(run, schema)


def training(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that labels may be learned from; the others are held out."""
    return docs.where(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score(docs, train(training(docs), training(labels)), keep=["doc_id"])
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), F.col("_tw_score").alias("score"), (F.col("_tw_score") >= THRESHOLD).cast("int").alias("predicted"), F.col("_tw_spans").alias("spans"))
