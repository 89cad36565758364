"""Operator 10: token ids in training order, in binary shards of fixed stride.

Documents (ids and an end id) of each input task are joined in row order and cut into
sequences of ``seq_len`` ids; only the last of a task is shorter. Sequences number from
0 on, task by task. A keyed Feistel network over the least even number of bits that can
number them all, walked until it falls below their count, is a permutation: it gives
each sequence its slot in training order. No table of the order exists anywhere, and
the slot of any sequence, or the sequence of any slot, is computed in constant time.

A shard holds a range of ``shard_slots`` slots: a header of 64 bytes and records of a
fixed stride (number of ids, checksum, ids, zeros), so the record of slot s is at a
computed offset, and reading resumes at any slot. Token ids are written once to a staging
table in the shared folder, which gives the counts; they then move to the task of their
shard in compressed bundles, and that task writes the file, under a name of its own and
renamed when complete. A task that is run again finds a complete file of the same content
and leaves it; a folder that has shards already is refused.

Cases: ids are numbers or null (other ids raise); null and empty texts are the end id alone; equal texts have equal ids; repeated
rows are written each; a text of any length goes on over as many sequences as it needs;
an empty table gives no shard and an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blobs, shared_dir, ship, slices, table, task, tokenizer_path
from .tokens import encoder

SEQ_LEN, SHARD_SLOTS, KEY, END_ID = 1024, 16_384, 0x5EED_0F_0DD5, 1
#: Sequences in a row of the staging table, and bytes of ids in a bundle.
ROW_SEQUENCES, BUNDLE_BYTES = 64, 16_000_000
HEADER, MAGIC = 64, b"TIDESEQ1"
ROUNDS, LEVEL = 6, 4
#: Tasks that write shards are as many as shards, and at most so many.
MAX_TASKS = 20_000
#: Stands for a null id within a bundle.
NO_ID = -(1 << 63)
MANIFEST = "slot long, shard int, offset long, sequence long, n_ids int, ids_crc32 long, doc_ids array<long>"


def _round_keys(key: int) -> list[np.uint64]:
    out, x = [], key & (1 << 64) - 1
    for _ in range(ROUNDS):
        x = (x + 0x9E3779B97F4A7C15) & (1 << 64) - 1
        z = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        out.append(np.uint64((z ^ z >> 27) * 0x94D049BB133111EB & (1 << 64) - 1))
    return out


def _mixed(half: np.ndarray, key: np.uint64, mask: np.uint64) -> np.ndarray:
    x = (half ^ key) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (x ^ (x >> np.uint64(32))) & mask


def slots(sequences: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """The slot of each sequence number below n, or with ``inverse`` the sequence of each slot."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = _round_keys(key)
    out = np.asarray(sequences, np.uint64).copy()
    walking = np.arange(len(out))
    while len(walking):
        x = out[walking]
        left, right = x >> shift, x & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ _mixed(left, k, mask), left
            else:
                left, right = right, left ^ _mixed(right, k, mask)
        x = left << shift | right
        out[walking] = x
        walking = walking[x >= np.uint64(n)]
    return out.astype(np.int64)


def _stage(docs: DataFrame, vocabulary: str, seq_len: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of up to 64 sequences: part, row, ids, and the documents in them with the place of each one's first id there."""

    @task("tokens")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, size = TaskContext.get().partitionId(), 0, 2 * seq_len * ROW_SEQUENCES
        end = np.array([end_id], "<u2").tobytes()
        held, docs_held, begins = bytearray(), [], []

        def cut(last: bool = False) -> Iterator[pa.RecordBatch]:
            nonlocal held, docs_held, begins, row
            while len(held) >= size or last and held:
                ids, rest = bytes(held[:size]), held[size:]
                inside = [i for i, b in enumerate(begins) if 2 * b < len(ids)]
                columns = [[part], [row], [ids], [[docs_held[i] for i in inside]], [[begins[i] for i in inside]]]
                kinds = [pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "row", "ids", "docs", "begins"])
                # A document that goes on stands first in the next row.
                n = len(ids) // 2
                after = [(d, b - n) for d, b in zip(docs_held, begins, strict=True) if b >= n]
                if rest and (not after or after[0][1] > 0):
                    after.insert(0, (docs_held[inside[-1]], 0))
                held, docs_held, begins, row = rest, [d for d, _ in after], [b for _, b in after], row + 1

        for whole in batches:
            for batch in slices(whole, text_col):
                for d, x in zip(batch.column(id_col).to_pylist(), encoder(vocabulary).encode([x or b"" for x in blobs(batch.column(text_col))]), strict=True):
                    docs_held.append(d)
                    begins.append(len(held) // 2)
                    held += x + end
                    if len(held) >= size:
                        yield from cut()
        yield from cut(last=True)

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, "part int, row int, ids binary, docs array<long>, begins array<long>")


def _bundles(staged: DataFrame, before: dict[int, int], n: int, seq_len: int, shard_slots: int, key: int) -> DataFrame:
    """Compressed bundles of sequences for each shard."""
    shared = staged.sparkSession.sparkContext.broadcast(before)

    @task("tokens")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, list[int]]] = []  # sequence, ids, documents
        codec = pa.Codec("zstd", LEVEL)
        size = 0

        def flush() -> pa.RecordBatch:
            slot = slots(np.array([x[0] for x in held], np.int64), n, key) if held else np.zeros(0, np.int64)
            by: dict[int, list[int]] = {}
            for i in np.argsort(slot, kind="stable").tolist():
                by.setdefault(int(slot[i]) // shard_slots, []).append(i)
            rows = []
            for shard, own in by.items():
                head = np.array([(slot[i], held[i][0], len(held[i][1]) // 2, len(held[i][2])) for i in own], "<i8").tobytes()
                raw = len(own).to_bytes(4, "little") + head + b"".join(np.array([NO_ID if d is None else d for d in held[i][2]], "<i8").tobytes() for i in own) + b"".join(held[i][1] for i in own)
                rows.append((shard, len(raw), codec.compress(raw, asbytes=True)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["shard", "raw", "bundle"])

        for batch in batches:
            for part, row, ids, docs, begins in zip(*(batch.column(c).to_pylist() for c in ("part", "row", "ids", "docs", "begins")), strict=True):
                ends = [*begins[1:], len(ids) // 2]
                first = shared.value[part] + row * ROW_SEQUENCES
                for k in range(-(-len(ids) // (2 * seq_len))):
                    a, b = k * seq_len, (k + 1) * seq_len
                    lo, hi = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(begins, b, "left"))
                    held.append((first + k, ids[2 * a : 2 * b], docs[lo:hi]))
                size += len(ids)
                if size >= BUNDLE_BYTES:
                    yield flush()
                    size = 0
        yield flush()

    return staged.mapInArrow(run, "shard int, raw long, bundle binary")


def _unbundle(raw: bytes) -> Iterator[tuple[int, int, bytes, list[int]]]:
    n = int.from_bytes(raw[:4], "little")
    head = np.frombuffer(raw, "<i8", 4 * n, 4).reshape(n, 4)
    docs_at, ids_at = 4 + 32 * n, 4 + 32 * n + 8 * int(head[:, 3].sum())
    for slot, sequence, ids, docs in head.tolist():
        yield slot, sequence, raw[ids_at : ids_at + 2 * ids], [None if d == NO_ID else d for d in np.frombuffer(raw, "<i8", docs, docs_at).tolist()]
        docs_at, ids_at = docs_at + 8 * docs, ids_at + 2 * ids


def stride(seq_len: int) -> int:
    return -(-(8 + 2 * seq_len) // 8) * 8


def _records(data: bytes, seq_len: int) -> list[bytes]:
    """The ids of each record, checked against its checksum."""
    out, step = [], stride(seq_len)
    for at in range(0, len(data), step):
        n, crc = int.from_bytes(data[at : at + 4], "little"), int.from_bytes(data[at + 4 : at + 8], "little")
        ids = data[at + 8 : at + 8 + 2 * n]
        if zlib.crc32(ids) != crc:
            raise ValueError("record checksum")
        out.append(ids)
    return out


def _shards(bundles: DataFrame, folder: str, n: int, seq_len: int, shard_slots: int) -> DataFrame:
    """Write each shard, read it back, and give a manifest row for each of its slots."""

    def write(shard: int, parts: list[bytes]) -> pa.RecordBatch:
        first, step = shard * shard_slots, stride(seq_len)
        count = min(shard_slots, n - first)
        body, seen = bytearray(count * step), {}
        for raw in parts:
            for slot, sequence, ids, docs in _unbundle(raw):
                at = (slot - first) * step
                body[at : at + 8 + len(ids)] = (len(ids) // 2).to_bytes(4, "little") + zlib.crc32(ids).to_bytes(4, "little") + ids
                seen[slot] = (sequence, docs)
        if len(seen) != count:
            raise ValueError(f"shard {shard} has {len(seen)} of {count} sequences")
        header = MAGIC + b"".join(x.to_bytes(8, "little") for x in (step, seq_len, first, count))
        system, base = fs.FileSystem.from_uri(folder)
        name, own = f"{base}/shard-{shard:06d}.bin", f"{base}/.{shard}-{uuid.uuid4().hex}"
        with system.open_output_stream(own) as out:
            out.write(header.ljust(HEADER, b"\0"))
            out.write(bytes(body))
        try:  # a task that ran before, or runs beside this one, has left the same file
            if system.get_file_info(name).type == fs.FileType.NotFound:
                system.move(own, name)
            else:
                system.delete_file(own)
        except OSError:
            if system.get_file_info(name).type == fs.FileType.NotFound:
                raise
            system.delete_file(own)
        with system.open_input_file(name) as back:
            ids = _records(back.read()[HEADER:], seq_len)
        rows = range(first, first + count)
        columns = [list(rows), [shard] * count, [HEADER + (s - first) * step for s in rows], [seen[s][0] for s in rows], [len(x) // 2 for x in ids], [zlib.crc32(x) for x in ids], [seen[s][1] for s in rows]]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["slot", "shard", "offset", "sequence", "n_ids", "ids_crc32", "doc_ids"])

    @task("tokens")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, shard, parts = pa.Codec("zstd"), None, []
        for batch in batches:
            for s, size, x in zip(batch.column("shard").to_pylist(), batch.column("raw").to_pylist(), blobs(batch.column("bundle")), strict=True):
                if shard is not None and s != shard:
                    yield write(shard, parts)
                    parts = []
                shard = s
                parts.append(codec.decompress(x, size, asbytes=True))
        if shard is not None:
            yield write(shard, parts)

    # Each task gets a range of shards: one, or as many as MAX_TASKS tasks leave it.
    shards = max(1, -(-n // shard_slots))
    tasks = min(shards, MAX_TASKS)
    own = F.expr(f"cast(shard * {tasks}L div {shards} as int)")
    return bundles.repartitionById(tasks, own).sortWithinPartitions("shard").mapInArrow(run, MANIFEST)


def materialise(
    docs: DataFrame, folder: str, vocabulary: str, seq_len: int = SEQ_LEN, shard_slots: int = SHARD_SLOTS, key: int = KEY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write the shards and meta.json into ``folder``; the manifest, a row for each sequence, is a table there."""
    spark = docs.sparkSession
    staging, manifest = f"{folder}/staging", f"{folder}/manifest"
    system, base = fs.FileSystem.from_uri(folder)
    if system.get_file_info(f"{base}/shards").type != fs.FileType.NotFound:
        raise FileExistsError(f"{folder} has shards")
    _stage(docs, vocabulary, seq_len, end_id, id_col, text_col).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", LEVEL).parquet(staging)
    staged = spark.read.schema("part int, row int, ids binary, docs array<long>, begins array<long>").parquet(staging)
    counted = staged.groupBy("part").agg(F.sum(F.ceil(F.octet_length("ids") / (2 * seq_len))).alias("n")).collect()
    before, n = {}, 0
    for r in sorted(counted, key=lambda r: r["part"]):  # one row for each task
        before[r["part"]], n = n, n + r["n"]
    system.create_dir(f"{base}/shards", recursive=True)
    _shards(_bundles(staged, before, n, seq_len, shard_slots, key), f"{folder}/shards", n, seq_len, shard_slots).write.parquet(manifest)
    with system.open_output_stream(f"{base}/shards/meta.json") as out:
        out.write(json.dumps({"sequences": n, "seq_len": seq_len, "stride": stride(seq_len), "header": HEADER, "shard_slots": shard_slots, "key": key}).encode())
    system.delete_dir(f"{base}/staging")
    return spark.read.schema(MANIFEST).parquet(manifest)


def read_slots(folder: str, start: int, count: int) -> list[np.ndarray]:
    """The ids of ``count`` sequences in training order from a slot on."""
    system, base = fs.FileSystem.from_uri(folder)
    with system.open_input_file(f"{base}/shards/meta.json") as f:
        meta = json.loads(f.read())
    out, slot, stop = [], start, min(start + count, meta["sequences"])
    while slot < stop:
        shard, at = divmod(slot, meta["shard_slots"])
        some = min(stop - slot, meta["shard_slots"] - at)
        with system.open_input_file(f"{base}/shards/shard-{shard:06d}.bin") as f:
            f.seek(meta["header"] + at * meta["stride"])
            out += [np.frombuffer(x, "<u2") for x in _records(f.read(some * meta["stride"]), meta["seq_len"])]
        slot += some
    return out


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    return materialise(table(spark, sf_dir, "documents"), folder, tokenizer_path())
