"""Operator 8: a hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(class | history) P(word | class, history), both softmaxes whose
features are n-grams and skips of the history, hashed into tables of weights: the last
word, the last two, the last but one and the last but two, for the word each with the
class. A head word has a row and a column
of its class's grid of ``SIDE`` by ``SIDE`` places, no two words the same; its logit is the
logarithm of its share of the class and the weights of its row and column, so a step costs
2 ``SIDE`` numbers a feature, not one a word, and the sum over all words of a class is one
product of matrices. END is a class of its own.

All counts are over all training rows: words in each task first, then by word. The
``head`` most frequent words are grouped into clusters by the frequent words around
them (a mixture fitted to their co-occurrence counts); a naive Bayes rule on letter
trigrams gives every other word, seen or not, its cluster. Head words of a cluster form
classes of like mass and at most ``SIDE`` squared words, its other words one class, whose
words have their plain shares: an unseen word that of words seen once (Good-Turing), and
counts as one type.

Each task takes adaptive gradient steps over all its training tokens from the same
weights, those of a step with the same word and history as one of their weight, and
returns its weights (half precision) with the times each feature occurred;
their mean, weighted by these, is the model (iterative parameter mixing). Small partitions
are read together. What tasks send is bounded for each task and so grows with the input;
the merged tables have a fixed size.

Scoring gathers features in sparse numpy batches. Counts of up to ``lookup`` of the most
frequent words are broadcast (a bounded number of words of bounded length); the rest of a
text's words, summed by document, are joined with the counts.

Cases: null and empty texts are their end alone; without training rows both scores are
0 (every token is the one unseen type); equal texts score alike; repeated rows count and
are scored each; rows without an id are learned from and not held out, ids are numbers
(other ids raise); an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blobs, checkpoint, coded_words, ship, slices, table, task

HEAD, LOOKUP, WORD_BYTES = 16_384, 262_144, 64
CLUSTERS, CONTEXTS, CLASSES, SIDE = 8, 32, 16, 32
TABLE_BITS, ROUNDS, RATE, INNER_RATE, STEP = 16, 1, 0.3, 0.1, 8192
LETTER_BITS = 15
#: Unlisted words whose codes a Python worker keeps.
CACHE = 300_000
END = b"\n"  # no word has it
#: Features of a history; each chooses the class and, with the class, the word.
FEATURES = 4
#: Rows of one product of matrices: few enough that it takes one thread.
PRODUCT = 224
#: Words, and bytes of words, that a task holds while it counts, besides those of a batch.
COUNTED, COUNTED_BYTES = 800_000, 32_000_000
#: Rows with more tokens than this in a step are summed one by one, the others together.
TOGETHER = 64
#: Training tokens that a task has at least, unless there are fewer tasks than cores.
TASK_TOKENS = 2_000_000


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-cased words between ASCII white space, and the end."""
    return [*(text or b"").lower().split(), END]


def _letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed letter trigrams of all words, and where each word's begin."""
    data = np.frombuffer(b"".join(b"\x01" + x[:WORD_BYTES] + b"\x02\x02" for x in words), np.uint8).astype(np.uint32)
    lengths = np.array([min(len(x), WORD_BYTES) + 3 for x in words])
    starts = np.cumsum(lengths) - lengths
    code = np.append(data[:-2] << 16 | data[1:-1] << 8 | data[2:], [0, 0]).astype(np.uint32)
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - LETTER_BITS)
    keep = np.ones(len(data), bool)
    keep[starts + lengths - 1] = keep[starts + lengths - 2] = False
    return code[keep], starts - 2 * np.arange(len(words))


def _places(known: pa.Array, words: pa.Array) -> np.ndarray:
    """Where each of some different words is among known ones, or -1."""
    at = pc.index_in(known, value_set=words)  # few words of the batch are hashed, not all that are known
    met = at.is_valid()
    out = np.full(len(words), -1)
    out[at.filter(met).to_numpy()] = np.flatnonzero(met.to_numpy(zero_copy_only=False))
    return out


class Classes:
    """Words to codes (listed words by frequency, then one for each cluster's unlisted words), codes to ids (head words, then one for each cluster's others) and ids to classes."""

    def __init__(self, listed: list[tuple[bytes, int]], head: int, around: np.ndarray):
        self.n_listed, head = len(listed), listed[:head]
        counts = np.array([n for _, n in head], np.float64)
        cluster = _mixture(around, counts)
        self.letters = self._letter_rule([x for x, _ in head], cluster)
        n = self.n_head = len(head)
        self.id_of = np.concatenate([np.arange(n), n + self.clusters([x for x, _ in listed[n:]]), n + np.arange(CLUSTERS)]).astype(np.int64)
        self.count_of = np.array([c for _, c in listed] + [0] * CLUSTERS, np.float64)
        self.class_of = np.zeros(n + CLUSTERS, np.int32)
        end = next((i for i, (x, _) in enumerate(head) if x == END), n)
        order = sorted((i for i in range(n) if i != end), key=lambda i: (cluster[i], -counts[i], i))
        total, done, last, k, place = counts[order].sum() if order else 0, 0.0, None, 0, 0
        self.place_of = np.full(n + CLUSTERS, -1, np.int32)  # in the class's grid
        for i in order:
            if last is not None and (cluster[i] != last or done >= total / CLASSES or place == SIDE * SIDE):
                k, done, place = k + 1, 0.0, 0
            self.class_of[i], self.place_of[i], last = k, place, cluster[i]
            done += counts[i]
            place += 1
        if end < n:
            k += 1
            self.class_of[end] = k
        self.class_of[n:] = k + 1 + np.arange(CLUSTERS)
        self.n = k + 1 + CLUSTERS
        mass = np.bincount(self.class_of[:n], counts, self.n)
        share = counts / mass[self.class_of[:n]]
        #: Shares of head words by class and place.
        self.grid = np.zeros((self.n, SIDE * SIDE), np.float32)
        own = np.flatnonzero(self.place_of[:n] >= 0)
        self.grid[self.class_of[own], self.place_of[own]] = share[own]
        self.grid = self.grid.reshape(-1, SIDE, SIDE)
        #: Words with codes, listed ones first, and the codes.
        self.known, self.code_of = pa.array([x for x, _ in listed], pa.large_binary()), np.arange(len(listed))

    def _letter_rule(self, words: list[bytes], cluster: np.ndarray) -> np.ndarray:
        out = np.full((1 << LETTER_BITS, CLUSTERS), 0.1)
        code, starts = _letters(words)
        np.add.at(out, (code, np.repeat(cluster, np.diff(np.append(starts, len(code))))), 1)
        share = np.bincount(cluster, minlength=CLUSTERS) + 1.0
        self.prior = np.log(share / share.sum())
        return np.log(out / out.sum(0)).astype(np.float32)

    def clusters(self, words: list[bytes]) -> np.ndarray:
        """Each word's cluster by its letters."""
        if not words:
            return np.zeros(0, np.int64)
        code, starts = _letters(words)
        return (np.add.reduceat(self.letters[code], starts, axis=0) + self.prior).argmax(1)

    def codes(self, words: pa.Array | list[bytes]) -> np.ndarray:
        """The codes of some different words."""
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.large_binary())
        out = _places(self.known, words)
        missing = out < 0
        out[~missing] = self.code_of[out[~missing]]
        if missing.any():
            new = words.filter(pa.array(missing))
            out[missing] = self.n_listed + self.clusters(new.to_numpy(zero_copy_only=False).tolist())
            kept = len(self.known) if len(self.known) + len(new) <= self.n_listed + CACHE else self.n_listed
            short = pc.less_equal(pc.binary_length(new), WORD_BYTES)
            self.known = pa.concat_arrays([self.known[:kept], new.filter(short)])
            self.code_of = np.concatenate([self.code_of[:kept], out[missing][short.to_numpy(zero_copy_only=False)]])
        return out


def _mixture(around: np.ndarray, counts: np.ndarray, rounds: int = 20) -> np.ndarray:
    """The most likely component of each row of counts, by hard expectation-maximisation."""
    share = (around + 0.5) / (around + 0.5).sum(1, keepdims=True)
    mean = around.sum(0) + 1.0
    mean = mean / mean.sum()
    # Start from the rows that stand out most from the components so far.
    centres = [mean]
    weight = np.sqrt(around.sum(1))
    while len(centres) < CLUSTERS:
        far = np.min([(share * (np.log(share) - np.log(c))).sum(1) for c in centres], axis=0) * weight
        centres.append(share[int(far.argmax())])
    c = np.array(centres)
    for _ in range(rounds):
        own = (around @ np.log(c).T).argmax(1)
        c = np.array([around[own == k].sum(0) + 20 * mean for k in range(CLUSTERS)])
        c = c / c.sum(1, keepdims=True)
    return own


def _past(ids: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """The last word before each token in its text, the last but one and the last but two, or that there is none."""
    t = np.arange(len(ids)) - start
    past = []
    for k in (1, 2, 3):
        x = np.full(len(ids), 1, np.int64)
        x[k:] = ids[:-k] + 2
        x[t < k] = 1
        past.append(x)
    return past


def _features(w1: np.ndarray, w2: np.ndarray, w3: np.ndarray) -> np.ndarray:
    m = np.uint64(0x9E3779B97F4A7C15)

    def hashed(x: np.ndarray, k: int) -> np.ndarray:
        return ((((x + np.uint64(k << 56)) * m) ^ ((x * m) >> np.uint64(29))) * m >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    single = np.arange(max(int(x.max(initial=0)) for x in (w1, w2, w3)) + 1, dtype=np.uint64)  # each word is hashed once
    out = np.empty((len(w1), FEATURES), np.int64)
    out[:, 0] = np.take(hashed(single, 0), w1)
    out[:, 1] = hashed((w1 << 24 | w2).astype(np.uint64), 1)
    out[:, 2] = np.take(hashed(single, 2), w2)
    out[:, 3] = np.take(hashed(single, 3), w3)
    return out


def history(ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rows of the weight table for each token: hashed features of the words before it in its text."""
    return _features(*_past(ids, start))


def _keys(past: list[np.ndarray], classes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Numbers that only tokens of one word after the same three words share, in order of class."""
    bits = int(max(int(x.max(initial=0)) for x in past)).bit_length()
    below, inside = 3 * bits, (SIDE * SIDE).bit_length()
    if int(classes.max(initial=0)).bit_length() + below + inside > 63:  # too many words: none are put together
        at = max(1, len(classes)).bit_length()
        return classes.astype(np.int64) << at | np.arange(len(classes))
    out = classes.astype(np.int64)
    for x in past:
        out = out << bits | x
    return out << inside | places + 1


def _alike(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One token of each key in order of keys, how many have its key, and all tokens in that order."""
    order = np.argsort(keys)
    found = np.take(keys, order)
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])[: len(found)])
    return np.take(order, first), np.diff(np.append(first, len(order))), order


def within(rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Rows of the word factor's table: the first features with the class."""
    return rows ^ (classes.astype(np.int64) * 40_503 & (1 << TABLE_BITS) - 1)[:, None]


def _sums(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The sum of some rows of a table for each token."""
    out = np.take(weights, rows[:, 0], 0)
    for k in range(1, rows.shape[1]):
        out += np.take(weights, rows[:, k], 0)
    return out


def _exp(z: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
    """Exponentials of rows and what was taken off them first; that is 0 unless they could overflow."""
    if not z.size or max(float(z.max()), -float(z.min())) < 60:
        return np.exp(z), 0.0
    top = z.max(1, keepdims=True)
    return np.exp(z - top), top[:, 0]


def _logits(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | float]:
    """Of all classes the logits, numbers like the probabilities, the sums of these, and what was taken off the logits for them."""
    z = _sums(weights, rows)
    z += bias
    p, top = _exp(z)
    return z, p, p @ np.ones(p.shape[1], np.float32), top


class Inner:
    """P(word | class, history) of some tokens, each of a class with a grid, in order of class."""

    def __init__(self, weights: np.ndarray, grid: np.ndarray, rows: np.ndarray, classes: np.ndarray, places: np.ndarray):
        z = self.z = _sums(weights, rows)
        self.row, self.column = places // SIDE, places % SIDE
        self.share_at = classes.astype(np.int64) * SIDE * SIDE + places
        if max(float(z.max()), -float(z.min())) < 60:
            both, self.off = np.exp(z), 0.0
            self.left, self.right = both[:, :SIDE], both[:, SIDE:]
        else:
            (self.left, top), (self.right, more) = _exp(z[:, :SIDE]), _exp(z[:, SIDE:])
            self.off = top + more
        self.spread = np.empty((len(z), SIDE), np.float32)  # each row's sum over its columns
        self.grid = grid
        edges = np.flatnonzero(np.diff(classes, prepend=-1, append=-1)).tolist()
        self.spans = [(slice(at, min(at + PRODUCT, b)), int(classes[a])) for a, b in zip(edges[:-1], edges[1:], strict=True) for at in range(a, b, PRODUCT)]
        for own, c in self.spans:
            np.matmul(self.right[own], grid[c].T, out=self.spread[own])
        self.mass = np.einsum("ij,ij->i", self.left, self.spread)

    @property
    def logs(self) -> np.ndarray:
        at = np.arange(len(self.z)) * self.z.shape[1]
        return np.take(self.z, at + self.row) + np.take(self.z, at + SIDE + self.column) + np.log(np.take(self.grid, self.share_at)) - np.log(self.mass) - self.off

    def errors(self, times: np.ndarray | float = 1.0) -> np.ndarray:
        """The gradient of the logarithm by the sums of row and of column weights, for so many tokens alike."""
        out = np.empty((len(self.mass), 2 * SIDE), np.float32)
        left = self.left * (-times / self.mass)[:, None]
        np.multiply(left, self.spread, out=out[:, :SIDE])
        for own, c in self.spans:
            np.multiply(self.right[own], left[own] @ self.grid[c], out=out[own, SIDE:])
        flat, at = out.reshape(-1), np.arange(len(out)) * out.shape[1]
        flat[at + self.row] += times
        flat[at + SIDE + self.column] += times
        return out


class Learner:
    """One table of weights and its adaptive steps."""

    def __init__(self, weights: np.ndarray):
        self.w = weights.copy()
        self.seen, self.squares = np.zeros(len(weights), np.int64), np.full(len(weights), 1e-4, np.float32)

    def step(self, rows: np.ndarray, error: np.ndarray, times: np.ndarray, rate: float) -> None:
        """A step by tokens' rows and errors, each of so many tokens alike."""
        own, times, grad = _row_sums(rows, error, times)
        self.seen[own] += times
        squares = self.squares[own] + np.einsum("ij,ij->i", grad, grad) / np.float32(grad.shape[1])
        self.squares[own] = squares
        grad *= (np.float32(rate) / np.sqrt(squares))[:, None]
        grad += np.take(self.w, own, 0)
        # A row is one value of so many bytes: copied whole.
        whole = np.dtype((np.void, grad.itemsize * grad.shape[1]))
        np.put(self.w.view(whole), own, grad.view(whole))


def _learn(outer: Learner, inner: Learner, bias: np.ndarray, model: Classes, ids: np.ndarray, start: np.ndarray) -> None:
    """A pass of steps over some tokens. Those of a step that are alike are worked out once and weigh as many."""
    past, target, place = _past(ids, start), model.class_of[ids], model.place_of[ids]
    rows, keys = _features(*past), _keys(past, target, place)
    for at in range(0, len(ids), STEP):
        own, times, _ = _alike(keys[at : at + STEP])
        own += at
        r, y, p, n = rows[own], target[own], place[own], times.astype(np.float32)
        _, error, mass, _ = _logits(outer.w, bias, r)
        error *= (n / mass)[:, None]
        error.reshape(-1)[np.arange(len(y)) * error.shape[1] + y] -= n
        outer.step(r, error, times, -RATE)
        some = np.count_nonzero(p >= 0)  # classes with a grid come first
        if some:
            r = within(r[:some], y[:some])
            error = Inner(inner.w, model.grid, r, y[:some], p[:some]).errors(n[:some])
            inner.step(r, error, times[:some], INNER_RATE)


def _logs(outer: np.ndarray, inner: np.ndarray, bias: np.ndarray, model: Classes, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The natural logarithm of each token's probability; of a tail word, of its class's. Tokens that are alike are worked out once."""
    past = _past(ids, start)
    own, times, order = _alike(_keys(past, model.class_of[ids], model.place_of[ids]))
    rows, own = _features(*(x[own] for x in past)), ids[own]
    target, place = model.class_of[own], model.place_of[own]
    found = np.empty(len(own))
    some = np.count_nonzero(place >= 0)  # classes with a grid come first
    for at in range(0, len(own), STEP):
        r, y = rows[at : at + STEP], target[at : at + STEP]
        z, _, mass, top = _logits(outer, bias, r)
        found[at : at + STEP] = np.take(z, np.arange(len(z)) * z.shape[1] + y) - np.log(mass) - top
        n = min(some - at, len(y))
        if n > 0:
            found[at : at + n] += Inner(inner, model.grid, within(r[:n], y[:n]), y[:n], place[at : at + n]).logs
    out = np.empty(len(ids))
    out[order] = np.repeat(found, times)
    return out


def _row_sums(rows: np.ndarray, error: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of the table that a step uses, the most used ones first, how often (by the tokens' weights, if given), and the sum of their tokens' errors."""
    flat = rows.ravel().astype(np.uint16 if TABLE_BITS <= 16 else np.int64)  # short numbers sort in linear time
    order = np.argsort(flat, kind="stable")
    used, token = np.take(flat, order), order // rows.shape[1]
    first = np.flatnonzero(np.concatenate([[True], used[1:] != used[:-1]]))
    times = np.diff(np.append(first, len(used)))
    falling = np.argsort((len(used) - times).astype(np.uint16 if len(used) < 1 << 16 else np.int64), kind="stable")
    whole = times if weights is None else np.add.reduceat(np.take(weights, token), first)
    first, times, whole = np.take(first, falling), np.take(times, falling), np.take(whole, falling)
    grad = np.take(error, np.take(token, first), 0)
    # So many rows have more tokens than 0, 1, 2 and so on: their next token's errors are added together, without a step for each row.
    more = len(times) - np.cumsum(np.bincount(np.minimum(times, TOGETHER + 1)))
    often = int(more[TOGETHER]) if len(more) > TOGETHER else 0
    for i in range(often):
        grad[i] = error.take(token[first[i] : first[i] + times[i]], 0).sum(0)
    for k, n in enumerate(more[1:TOGETHER].tolist(), 1):
        if n > often:
            grad[often:n] += error.take(token.take(first[often:n] + k), 0)
    return np.take(used, first).astype(np.int64), whole, grad


def _coded(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct tokens of some texts, for all tokens in a row the place of each there, their number in each text, and for each token where its text starts."""
    found, index, sizes = coded_words(column)
    lengths = sizes + 1
    ends = np.cumsum(lengths)
    inside = np.ones(int(lengths.sum()), bool)
    inside[ends - 1] = False
    out = np.full(len(inside), len(found), np.int64)
    out[inside] = index
    return pa.concat_arrays([found, pa.array([END], found.type)]), out, lengths, np.repeat(ends - lengths, lengths)


def _flat(column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """As ``_coded``, with the tokens as bytes objects."""
    words, *rest = _coded(column)
    return words.to_numpy(zero_copy_only=False).tolist(), *rest


def _count(docs: DataFrame, text_col: str) -> DataFrame:
    kind = pa.schema({"word": pa.binary(), "n": pa.int64()})

    @task("maxent")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = pa.array([], pa.large_binary()), np.zeros(0, np.int64)
        for whole in batches:
            for batch in slices(whole, text_col):
                words, index, _, _ = _coded(batch.column(text_col))
                n = np.bincount(index, minlength=len(words))
                at = _places(known, words)
                new = at < 0
                counts[at[~new]] += n[~new]
                known, counts = pa.concat_arrays([known, words.filter(pa.array(new))]), np.append(counts, n[new])
                if len(known) > COUNTED or known.nbytes > COUNTED_BYTES:
                    yield from pa.table([known, counts], ["word", "n"]).cast(kind).to_batches(65_536)
                    known, counts = known[:0], counts[:0]
        if len(known):
            yield from pa.table([known, counts], ["word", "n"]).cast(kind).to_batches(65_536)

    return docs.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _frequent(counts: DataFrame, limit: int) -> list[tuple[bytes, int]]:
    """Words from the least frequency on that at most ``limit`` of them have; longer ones than a bound are left out.

    Frequencies are first counted in steps of a 64th of an octave, so the driver gets some
    thousand numbers and then at most ``limit`` words, not the best of every task.
    """
    short = counts.where(F.octet_length("word") <= WORD_BYTES).withColumn("step", F.floor(F.log2("c") * 64).cast("int"))
    total, least = 0, None
    for r in sorted(short.groupBy("step").count().collect(), key=lambda r: -r["step"]):
        total += r["count"]
        if total > limit:
            break
        least = r["step"]
    if least is None:
        return []
    rows = short.where(F.col("step") >= least).select("word", "c").toArrow()
    return sorted(zip(blobs(rows.column("word")), rows.column("c").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))


def _around(docs: DataFrame, head: list[bytes], text_col: str) -> np.ndarray:
    """How often each context word stands within two words of each head word."""
    shared = docs.sparkSession.sparkContext.broadcast(pa.array(head, pa.large_binary()))

    @task("maxent")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(shared.value)
        held = np.zeros(n * CONTEXTS, np.int64)
        for whole in batches:
            for batch in slices(whole, text_col):
                words, index, _, start = _coded(batch.column(text_col))
                ids = np.take(_places(shared.value, words), index)
                at = np.flatnonzero((ids >= 0) & (ids < CONTEXTS))
                pairs = []
                for k in (-2, -1, 1, 2):
                    good = at[(at + k >= 0) & (at + k < len(ids))]
                    good = good[(ids[good + k] >= 0) & (start[good] == start[good + k])]
                    pairs.append(ids[good + k] * CONTEXTS + ids[good])
                held += np.bincount(np.concatenate(pairs), minlength=len(held))
        cells = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(held[cells])], names=["cell", "n"])

    out = np.zeros(len(head) * CONTEXTS)
    for row in docs.select(text_col).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow().to_batches():
        out[row.column("cell").to_numpy()] = row.column("n").to_numpy()
    return out.reshape(len(head), CONTEXTS)


def _round(docs: DataFrame, classes, weights: np.ndarray, inner: np.ndarray, bias: np.ndarray, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """One pass of gradient steps in every task, and the mean of what they reach."""
    context, first_inner = docs.sparkSession.sparkContext, len(weights)
    start_from = context.broadcast((weights, inner, bias))

    @task("maxent")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, u, b = start_from.value
        learners, model = (Learner(w), Learner(u)), classes.value
        for whole in batches:
            for batch in slices(whole, text_col):
                words, index, _, start = _coded(batch.column(text_col))
                _learn(*learners, b, model, np.take(model.id_of[model.codes(words)], index), start)
        for first, own in zip((0, first_inner), learners, strict=True):
            rows = np.flatnonzero(own.seen)
            for at in range(0, len(rows), 8192):
                some = rows[at : at + 8192]
                reached = own.w[some].astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array((first + some).astype(np.int32)), pa.array(own.seen[some]), pa.array([x.tobytes() for x in reached], pa.binary())], names=["row", "times", "w"])

    @task("maxent")
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order; the sums of the last one are carried on."""
        carry: tuple[int, int, np.ndarray] | None = None
        for whole in batches:
            # Rows of the two tables have different widths.
            cut = int((whole.column("row").to_numpy() < first_inner).sum())
            for batch in (whole.slice(0, cut), whole.slice(cut)):
                if not batch.num_rows:
                    continue
                row, times = batch.column("row").to_numpy(), batch.column("times").to_numpy()
                mass = np.frombuffer(b"".join(blobs(batch.column("w"))), np.float16).reshape(len(row), -1) * times[:, None].astype(np.float64)
                first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                row, times, mass = row[first], np.add.reduceat(times, first), np.add.reduceat(mass, first, axis=0)
                if carry is not None:
                    if carry[0] == row[0]:
                        times[0] += carry[1]
                        mass[0] += carry[2]
                    else:
                        yield _merged(*([x] for x in carry))
                if len(row) > 1:
                    yield _merged(row[:-1], times[:-1], mass[:-1])
                carry = (row[-1], times[-1], mass[-1])
        if carry is not None:
            yield _merged(*([x] for x in carry))

    parts = docs.select(text_col).mapInArrow(run, "row int, times long, w binary")
    merged = parts.repartition("row").sortWithinPartitions("row").mapInArrow(merge, "row int, w binary").toArrow()
    rows, means = merged.column("row").to_numpy(), blobs(merged.column("w"))
    out = weights.copy(), inner.copy()
    for own, table_rows, mine in ((out[0], rows, rows < first_inner), (out[1], rows - first_inner, rows >= first_inner)):
        if mine.any():
            own[table_rows[mine]] = np.frombuffer(b"".join(means[i] for i in np.flatnonzero(mine)), np.float32).reshape(-1, own.shape[1])
    return out


def _merged(row, times, mass) -> pa.RecordBatch:
    mean = (np.array(mass) / np.array(times, np.float64)[:, None]).astype(np.float32)
    return pa.RecordBatch.from_arrays([pa.array(np.array(row, np.int32)), pa.array([x.tobytes() for x in mean], pa.binary())], names=["row", "w"])


def _tails(counts: DataFrame, classes) -> list[tuple[float, float, float]]:
    """For each cluster, over its words outside the head: tokens, types, and types seen once."""

    @task("maxent")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((CLUSTERS, 3))
        model = classes.value
        for batch in batches:
            words, c = batch.column("word").cast(pa.large_binary()), batch.column("c").to_numpy()
            ids = model.id_of[model.codes(words)]
            tail = ids >= model.n_head
            own, c = ids[tail] - model.n_head, c[tail]
            for j, x in enumerate((c, np.ones(len(c)), c == 1)):
                sums[:, j] += np.bincount(own, x, CLUSTERS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLUSTERS, dtype=np.int32)), *(pa.array(sums[:, j]) for j in range(3))], names=["k", "tokens", "types", "once"])

    rows = counts.mapInArrow(run, "k int, tokens double, types double, once double").groupBy("k").agg(*[F.sum(c).alias(c) for c in ("tokens", "types", "once")]).collect()
    out = [(0.0, 0.0, 0.0)] * CLUSTERS
    for r in rows:
        out[r["k"]] = (r["tokens"], r["types"], r["once"])
    return out


def score(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, head: int = HEAD, lookup: int = LOOKUP) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10) of every row of ``docs``."""
    context = ship(docs.sparkSession).sparkContext
    counts = checkpoint(_count(training, text_col))
    types, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    listed = _frequent(counts, lookup)
    top = listed[:head]
    classes = Classes(listed, head, _around(training, [x for x, _ in top], text_col)) if top else None
    shared = context.broadcast(classes)
    weights, inner, bias, tails = np.zeros((1 << TABLE_BITS, 1), np.float32), np.zeros((1 << TABLE_BITS, 2 * SIDE), np.float32), np.zeros(1, np.float32), []
    if classes:
        tails = _tails(counts, shared)
        mass = np.bincount(classes.class_of[: len(top)], [n for _, n in top], classes.n)
        mass[-CLUSTERS:] = [x[0] for x in tails]
        bias = np.log((mass + 0.5) / (mass + 0.5).sum()).astype(np.float32)
        weights = np.zeros((1 << TABLE_BITS, classes.n), np.float32)
        most = max(context.defaultParallelism, -(-total // TASK_TOKENS))
        for _ in range(rounds):
            weights, inner = _round(training.coalesce(most), shared, weights, inner, bias, text_col)
    # Of a cluster's other words: log10 of what an unseen one has, and of what each token of a seen one has.
    unseen = [np.log10((once + 0.5) / (n + once + 0.5)) for n, _, once in tails]
    each = [np.log10(max(n, 0.5) / (n + once + 0.5) / max(n, 0.5)) for n, _, once in tails]
    model = context.broadcast((weights, inner, bias, each, np.log10(total + 0.5 * (types + 1))))

    @task("maxent")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, u, bias, each, whole_log = model.value
        each = np.array(each)
        own = shared.value
        smooth = np.log10(own.count_of + 0.5) if own else None
        for whole in batches:
            for batch in slices(whole, text_col):
                words, index, lengths, start = _coded(batch.column(text_col))
                texts = len(lengths)
                doc = np.repeat(np.arange(texts), lengths)
                of_word = own.codes(words) if own else np.zeros(len(words), np.int64)
                codes = np.take(of_word, index)
                c = np.take(own.count_of, codes) if own else np.zeros(len(codes))
                listed = c > 0
                base = np.bincount(doc, np.where(listed, np.take(smooth, codes) - whole_log, 0), texts) if own else np.zeros(texts)
                model_score = np.zeros(texts)
                if own:
                    ids = np.take(own.id_of, codes)
                    logs = _logs(w, u, bias, own, ids, start) / np.log(10)
                    some = (ids >= own.n_head) & listed
                    logs[some] += np.log10(c[some]) + each[ids[some] - own.n_head]
                    model_score = np.bincount(doc, logs, texts)
                loose, times = np.unique((doc * len(words) + index)[~listed], return_counts=True)  # in order of texts
                at, loose = np.divmod(loose, len(words))
                ends = np.searchsorted(at, np.arange(texts + 1))
                cluster = np.take(of_word, loose) - own.n_listed if own else np.zeros(len(loose))
                known = np.bincount(doc[listed], minlength=texts)
                fields = [words.take(pa.array(loose)).cast(pa.binary()), pa.array(times, pa.int64()), pa.array(cluster.astype(np.int32))]
                loose_words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, names=["word", "n", "k"]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_col), pa.array(lengths, pa.int64()), pa.array(known, pa.int64()), pa.array(base.astype(float)), pa.array(model_score.astype(float)), loose_words], names=["doc_id", "n_tokens", "known", "base", "model", "rest"]
                )

    first = docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, "doc_id long, n_tokens long, known long, base double, model double, rest array<struct<word:binary,n:long,k:int>>")
    first = checkpoint(first.withColumn("uid", F.monotonically_increasing_id()))
    loose = first.select("uid", F.inline("rest")).join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    by_k = lambda values: F.element_at(F.array(*[F.lit(float(x)) for x in values]), F.col("k") + 1) if values else F.lit(0.0)
    tail = F.when(F.col("c") > 0, F.log10(F.col("c").cast("double")) + by_k(each)).otherwise(by_k(unseen)) if tails else F.lit(0.0)
    base = F.log10(F.col("c") + 0.5) - F.lit(float(np.log10(total + 0.5 * (types + 1))))
    sums = loose.groupBy("uid").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * base).alias("base2"), F.sum(F.col("n") * tail).alias("model2"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return first.drop("rest").join(sums, "uid", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + zero("more")).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base2")).alias("base_score"),
        (F.col("model") + zero("model2")).alias("score"),
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    out = score(docs, docs.where(~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
