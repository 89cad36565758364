"""Operator 9: documents in as few sequences as possible, by swap-based local search.

A document is its token ids and one end id. Longer ones are cut into pieces of the
sequence length; a full piece is a sequence by itself. The other pieces are dealt by
a hash into groups of about ``group_pieces``, so that no task holds more however many
there are. In each group next fit, in order of row number, gives the first bins; local
search then moves a piece to a fuller bin, exchanges one for one, or two for one, whenever
that raises the sum of squared fills, out of the emptiest bin until it is empty, again and
again, until the bins are as few as their lengths allow (``fewest``) or no bin has a move or
exchange left (or as many in a row as there were bins have emptied none). If it ends above that number, it is made once more from best
fit in order of decreasing length, and the fewer bins count. The emptiest bins of each group
are packed once more together, in groups of the same size.

Cases: ids are numbers (other ids raise); a null or empty text is the end id alone; repeated rows are packed each; equal
lengths go by row number; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blobs, checkpoint, ship, slices, table, task, tokenizer_path
from .tokens import encoder

LENGTH, END_ID, GROUP_PIECES = 4096, 1, 20_000
#: Of each group, the emptiest bins that are packed again together.
OPEN_BINS = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def next_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of places in ``lengths``, in their order; a piece that does not fit begins the next bin."""
    bins: list[list[int]] = []
    room = 0
    for i, n in enumerate(lengths):
        if n > room:
            bins.append([])
            room = size
        bins[-1].append(i)
        room -= n
    return bins


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of places in ``lengths``: longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(size + 1)]  # bins by their room
    mask = 0  # bit r: some bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        above = mask >> n
        if above:
            r = n + (above & -above).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
        else:
            b, r = len(bins), size
            bins.append([])
        bins[b].append(i)
        room[r - n].append(b)
        mask |= 1 << (r - n)
    return bins


def fewest(lengths: list[int], size: int) -> int:
    """Bins that the lengths need at least: by their total, and by those of which no k + 1 are in one bin."""
    ordered = sorted(lengths)
    by_count = [-(-(len(ordered) - bisect_right(ordered, size // (k + 1))) // k) for k in range(1, 65)]
    return max(-(-sum(lengths) // size), *by_count)


class Search:
    """Local search over bins of pieces: moves, one-for-one and two-for-one exchanges, each of which raises the sum of squared fills."""

    def __init__(self, bins: list[list[int]], lengths: list[int], size: int):
        self.size = size
        self.bins = [sorted((lengths[i], i) for i in b) for b in bins]
        self.sizes = [[n for n, _ in b] for b in self.bins]  # the same, for a quicker search
        self.fill = [sum(n for n, _ in b) for b in self.bins]
        self.at: list[set[int]] = [set() for _ in range(size + 1)]  # bins by their room
        self.mask = 0  # bit r: some bin has room r
        self.steps = {"move": 0, "one": 0, "two": 0}
        for b in range(len(bins)):
            self._put(b)

    def _put(self, b: int) -> None:
        r = self.size - self.fill[b]
        self.at[r].add(b)
        self.mask |= 1 << r

    def _take(self, b: int) -> None:
        r = self.size - self.fill[b]
        self.at[r].discard(b)
        if not self.at[r]:
            self.mask ^= 1 << r

    def _apply(self, source: int, piece: tuple[int, int], target: int, back: list[tuple[int, int]]) -> None:
        """``piece`` goes to the target and ``back`` comes from there; the source is not among the indexed bins."""
        gain = piece[0] - sum(n for n, _ in back)
        self._take(target)
        for here, there, some in ((source, target, [piece]), (target, source, back)):
            for x in some:
                k = bisect_left(self.bins[here], x)
                del self.bins[here][k], self.sizes[here][k]
                k = bisect_left(self.bins[there], x)
                self.bins[there].insert(k, x)
                self.sizes[there].insert(k, x[0])
        self.fill[target] += gain
        self.fill[source] -= gain
        self._put(target)
        self.steps[("move", "one", "two")[len(back)]] += 1

    def _best_in(self, target: int, n: int, room: int, below: int) -> tuple[int, list[tuple[int, int]]]:
        """The exchange of a piece of length n for one or two of the target's that gains most, more than ``below``, at most its room."""
        inside, gained, found = self.sizes[target], below, ()
        k = bisect_left(inside, n - room)
        if k < len(inside) and n - inside[k] > gained:
            gained, found = n - inside[k], (k,)
        # Two pieces of at least n - room and less than n - gained together.
        if gained < room and len(inside) > 1 and inside[0] + inside[1] < n - gained and inside[-1] + inside[-2] >= n - room:
            lo, hi = 0, bisect_left(inside, n - inside[0]) - 1
            while lo < hi and gained < room:
                gain = n - inside[lo] - inside[hi]
                if gain > room:
                    lo += 1
                    continue
                if gain > gained:
                    gained, found = gain, (lo, hi)
                hi -= 1
        return gained, [self.bins[target][k] for k in found]

    def _step(self, source: int) -> bool:
        """One move or exchange that takes tokens out of the source; false if there is none."""
        for piece in reversed(self.bins[source]):
            n = piece[0]
            above = self.mask >> n
            if above:  # the fullest bin that has room
                r = n + (above & -above).bit_length() - 1
                if self.size - r + n > self.fill[source]:
                    self._apply(source, piece, next(iter(self.at[r])), [])
                    return True
            best, target, left = (0, []), -1, self.mask & (1 << n) - 1
            while left and (r := left.bit_length() - 1) > best[0]:  # no exchange gains more than the room
                left ^= 1 << r
                for t in self.at[r]:
                    if self.sizes[t][0] >= n - best[0]:  # its pieces are too long to come back
                        continue
                    found = self._best_in(t, n, r, best[0])
                    if found[1] and self.fill[t] + found[0] > self.fill[source]:
                        best, target = found, t
                        if best[0] == r:
                            break
            if best[1]:
                self._apply(source, piece, target, best[1])
                return True
        return False

    def _emptiest(self, but: set[int]) -> int | None:
        left = self.mask & ~1  # full bins are no sources
        while left:
            r = left.bit_length() - 1
            left ^= 1 << r
            for b in self.at[r]:
                if b not in but:
                    return b
        return None

    def run(self) -> list[list[int]]:
        """Empty the emptiest bin, again and again, until the bins are as few as their lengths allow, no move or exchange out of any bin is left, or as many in a row as there were bins have emptied none."""
        least, count = fewest([n for b in self.bins for n, _ in b], self.size), len(self.bins)
        tried: set[int] = set()  # bins that nothing can leave as all others are
        alike: set[tuple[int, ...]] = set()  # their pieces' lengths
        patience, since = count, 0
        while count > least and since < patience and (source := self._emptiest(tried)) is not None:
            if (lengths := tuple(n for n, _ in self.bins[source])) in alike:
                tried.add(source)
                continue
            self._take(source)
            moved = False
            while self.bins[source] and since < patience and self._step(source):
                moved, since = True, since + 1
            if moved:
                tried.clear()
                alike.clear()
            if self.bins[source]:
                tried.add(source)
                alike.add(lengths if not moved else tuple(n for n, _ in self.bins[source]))
                self._put(source)
            else:
                count, since = count - 1, 0
        return [[i for _, i in b] for b in self.bins if b]


def pack(lengths: list[int], size: int = LENGTH) -> list[list[int]]:
    """Bins of places in ``lengths``; every length is 1 to ``size``."""
    bins = Search(next_fit(lengths, size), lengths, size).run()
    if len(bins) > fewest(lengths, size):
        bins = min(bins, Search(best_fit(lengths, size), lengths, size).run(), key=len)
    return bins


def pieces(docs: DataFrame, vocabulary: str, size: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length and checksum of the ids, for every piece."""

    @task("tokens")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for batch in slices(whole, text_col):
                doc, piece, start, length, crc = [], [], [], [], []
                ids = encoder(vocabulary).encode([x or b"" for x in blobs(batch.column(text_col))])
                for d, x in zip(batch.column(id_col).to_pylist(), ids, strict=True):
                    data = memoryview(np.frombuffer(x, "<u2").astype("<u4").tobytes() + end)
                    for k, at in enumerate(range(0, len(data), 4 * size)):
                        part = data[at : at + 4 * size]
                        doc.append(d)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, PIECES)


def _packed(rows: DataFrame, group, size: int, level: int) -> DataFrame:
    """(uid, sequence, offset, filled, open) of each piece; open: it is in one of its group's emptiest bins."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid")
        lengths = pdf["length"].tolist()
        uid, first = pdf["uid"].tolist(), int(pdf["group"].iloc[0])
        bins = pack(lengths, size)
        fills = [sum(lengths[i] for i in b) for b in bins]
        emptiest = {b for b in sorted(range(len(bins)), key=fills.__getitem__)[:OPEN_BINS] if fills[b] < size}
        out = []
        for b, inside in enumerate(bins):
            at = 0
            for i in inside:
                out.append((uid[i], (first << 24 | b) * 4 + level, at, b in emptiest))
                at += lengths[i]
        return pd.DataFrame(out, columns=["uid", "sequence_id", "offset", "open"])

    return rows.select("uid", "length", group.cast("long").alias("group")).groupBy("group").applyInPandas(run, "uid long, sequence_id long, offset long, open boolean")


def pack_pieces(parts: DataFrame, size: int = LENGTH, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The pieces with sequence_id and offset."""
    # The row number is fixed once the pieces are written.
    parts = checkpoint(parts.withColumn("uid", F.monotonically_increasing_id()))
    short = parts.where(F.col("length") < size)

    def group(n: int):
        return F.pmod(F.xxhash64("uid"), F.lit(max(1, -(-n // group_pieces))))

    many = short.count()
    first = _packed(short, group(many), size, 1)
    if many > group_pieces:
        first = checkpoint(first)
        rest = short.join(first.where("open").select("uid"), "uid")
        again = _packed(rest, group(first.where("open").count()), size, 2)
        first = first.where(~F.col("open")).unionByName(again)
    own = parts.where(F.col("length") == size).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("uid") * 4).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return short.join(first, "uid").select(own.columns).unionByName(own)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_pieces(pieces(table(spark, sf_dir, "documents"), tokenizer_path()))
