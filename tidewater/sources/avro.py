"""Avro object container files as a Spark data source in Python.

    spark.read.format("tidewater_avro").load(path)
    df.write.format("tidewater_avro").option("codec", "deflate").option("rollBytes", 1 << 27).save(path)

A file is read in splits of ``splitBytes`` (64 MB): a block belongs to the split in which the sync
marker before it begins, so each record is read once whatever the splits. Records come
in Arrow batches. The columns are those of ``avro_type``: a union of several types is its
value as text. A file's own schema decodes it; fields that it lacks are null, so files of
older and newer schemas can be read together with ``.schema(...)``.

A task writes files that it rolls before ``rollBytes`` are passed (a block alone may be longer)
or after ``rollRecords``; they have their name only once all tasks are done.
"""

from __future__ import annotations

import bz2
import json
import lzma
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, ByteType, DataType, DateType, DoubleType, FloatType, IntegerType, LongType, MapType, ShortType, StringType, StructType, TimestampNTZType, TimestampType

from .connectors import avro_type

MAGIC = b"Obj\x01"
SPLIT_BYTES, BLOCK_BYTES, BATCH_ROWS = 64 << 20, 64 << 10, 4096
#: Bytes read at a time in search of a sync marker, and at a file's head in search of its schema.
CHUNK = 1 << 20


def _zstandard():
    import zstandard

    return zstandard


CODECS: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {
    "null": (bytes, bytes),
    "deflate": (lambda x: zlib.compress(x, wbits=-15), lambda x: zlib.decompress(x, -15)),
    "bzip2": (bz2.compress, bz2.decompress),
    "xz": (lzma.compress, lzma.decompress),
    "zstandard": (lambda x: _zstandard().ZstdCompressor().compress(x), lambda x: _zstandard().ZstdDecompressor().decompressobj().decompress(x)),
}

# values as bytes


def put_long(out: bytearray, n: int) -> None:
    n = (n << 1) ^ (n >> 63)
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)


def get_long(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 0x7F) << shift
        if byte < 0x80:
            return (n >> 1) ^ -(n & 1), at
        shift += 7


def _as_text(value: object) -> str | None:
    """A value of a union of several types."""
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, default=lambda x: x.decode("latin-1"))


Decoder = Callable[[bytes, int], tuple[object, int]]


def decoder(schema, named: dict | None = None) -> Decoder:
    """What reads a value of a (parsed) schema from bytes at a place and gives it with the place after it."""
    named = {} if named is None else named
    if isinstance(schema, list):
        parts = [decoder(x, named) for x in schema]
        text = sum(x != "null" for x in schema) > 1

        def union(data: bytes, at: int) -> tuple[object, int]:
            which, at = get_long(data, at)
            value, at = parts[which](data, at)
            return (_as_text(value) if text else value), at

        return union
    kind = schema if isinstance(schema, str) else schema["type"]
    if isinstance(kind, (list, dict)):
        return decoder(kind, named)
    if kind in named:
        return lambda data, at: named[kind](data, at)
    if kind == "record":
        named[schema["name"]] = lambda data, at: record(data, at)
        fields = [(f["name"], decoder(f["type"], named)) for f in schema["fields"]]

        def record(data: bytes, at: int) -> tuple[object, int]:
            out = {}
            for name, part in fields:
                out[name], at = part(data, at)
            return out, at

        return record
    if kind in ("array", "map"):
        item = decoder(schema["items"] if kind == "array" else schema["values"], named)
        keyed = kind == "map"

        def several(data: bytes, at: int) -> tuple[object, int]:
            out = []
            while True:
                n, at = get_long(data, at)
                if n == 0:
                    return out, at
                if n < 0:  # followed by the bytes of the block
                    n = -n
                    _, at = get_long(data, at)
                for _ in range(n):
                    if keyed:
                        key, at = _string(data, at)
                        value, at = item(data, at)
                        out.append((key, value))
                    else:
                        value, at = item(data, at)
                        out.append(value)

        return several
    if kind == "fixed":
        size = schema["size"]
        made = lambda data, at: (bytes(data[at : at + size]), at + size)
    elif kind == "enum":
        symbols = schema["symbols"]

        def made(data: bytes, at: int) -> tuple[object, int]:
            which, at = get_long(data, at)
            return symbols[which], at

    else:
        return _PLAIN[kind]
    named[schema["name"]] = made
    return made


def _bytes(data: bytes, at: int) -> tuple[bytes, int]:
    n, at = get_long(data, at)
    return bytes(data[at : at + n]), at + n


def _string(data: bytes, at: int) -> tuple[str, int]:
    found, at = _bytes(data, at)
    return found.decode(), at


_PLAIN: dict[str, Decoder] = {
    "null": lambda data, at: (None, at),
    "boolean": lambda data, at: (data[at] == 1, at + 1),
    "int": get_long,
    "long": get_long,
    "float": lambda data, at: (struct.unpack_from("<f", data, at)[0], at + 4),
    "double": lambda data, at: (struct.unpack_from("<d", data, at)[0], at + 8),
    "bytes": _bytes,
    "string": _string,
}

#: Avro's name of a column type.
_NAMES = {BooleanType: "boolean", ByteType: "int", ShortType: "int", IntegerType: "int", LongType: "long", FloatType: "float", DoubleType: "double", StringType: "string", BinaryType: "bytes"}


def schema_of(kind: DataType, name: str = "row") -> object:
    """The schema of a column type; every field may be null."""
    if isinstance(kind, StructType):
        return {"type": "record", "name": name, "fields": [{"name": f.name, "type": ["null", schema_of(f.dataType, f"{name}_{f.name}")], "default": None} for f in kind]}
    if isinstance(kind, ArrayType):
        return {"type": "array", "items": ["null", schema_of(kind.elementType, f"{name}_item")]}
    if isinstance(kind, MapType):
        return {"type": "map", "values": ["null", schema_of(kind.valueType, f"{name}_value")]}
    if isinstance(kind, DateType):
        return {"type": "int", "logicalType": "date"}
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return {"type": "long", "logicalType": "timestamp-micros" if isinstance(kind, TimestampType) else "local-timestamp-micros"}
    if type(kind) not in _NAMES:
        raise ValueError(f"no Avro type for {kind.simpleString()}")
    return _NAMES[type(kind)]


Encoder = Callable[[bytearray, object], None]


def encoder(kind: DataType) -> Encoder:
    """What appends a value of a column type, which is not null."""

    def maybe(part: Encoder) -> Encoder:
        def run(out: bytearray, value: object) -> None:
            if value is None:
                out.append(0)
            else:
                out.append(2)
                part(out, value)

        return run

    def raw(out: bytearray, value: bytes) -> None:
        put_long(out, len(value))
        out += value

    if isinstance(kind, StructType):
        parts = [maybe(encoder(f.dataType)) for f in kind]

        def record(out: bytearray, value: object) -> None:
            for part, x in zip(parts, value, strict=True):
                part(out, x)

        return record
    if isinstance(kind, (ArrayType, MapType)):
        keyed = isinstance(kind, MapType)
        item = maybe(encoder(kind.valueType if keyed else kind.elementType))

        def several(out: bytearray, value: object) -> None:
            if value:
                put_long(out, len(value))
                for x in value:
                    if keyed:
                        raw(out, x.encode())
                    item(out, value[x] if keyed else x)
            out.append(0)

        return several
    name = schema_of(kind)
    if isinstance(name, dict):  # days or microseconds since the epoch
        import datetime as dt

        if isinstance(kind, DateType):
            return lambda out, v: put_long(out, v.toordinal() - 719_163)

        def instant(out: bytearray, v: dt.datetime) -> None:
            since = v - dt.datetime(1970, 1, 1, tzinfo=v.tzinfo) if v.tzinfo else v - dt.datetime(1970, 1, 1)
            put_long(out, (since.days * 86_400 + since.seconds) * 1_000_000 + since.microseconds)

        return instant
    return {
        "boolean": lambda out, v: out.append(1 if v else 0),
        "int": put_long,
        "long": put_long,
        "float": lambda out, v: out.extend(struct.pack("<f", v)),
        "double": lambda out, v: out.extend(struct.pack("<d", v)),
        "bytes": lambda out, v: raw(out, bytes(v)),
        "string": lambda out, v: raw(out, v.encode()),
    }[name]


# files


def system_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub("^file:/(?!//)", "file:///", path))
    return fs.LocalFileSystem(), os.path.abspath(path)


def files_of(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """The file system of a path and its files: itself, or those below it whose names don't begin with a dot or underscore."""
    system, at = system_of(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return system, [info]
    found = system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    return system, sorted((x for x in found if x.type == fs.FileType.File and x.base_name[0] not in "._"), key=lambda x: x.path)


@dataclass
class Header:
    schema: dict | str
    codec: str
    sync: bytes
    length: int


def read_header(system: fs.FileSystem, path: str) -> Header:
    data = b""
    with system.open_input_stream(path) as source:
        while True:
            more = source.read(CHUNK)
            data += more
            try:
                return _header(data, path)
            except IndexError:
                if not more:
                    raise ValueError(f"{path} ends in its header") from None


def _header(data: bytes, path: str) -> Header:
    if data[:4] != MAGIC:
        raise ValueError(f"{path} is no Avro container")
    found, at = decoder({"type": "map", "values": "bytes"})(data, 4)
    if len(data) < at + 16:
        raise IndexError
    meta = dict(found)
    return Header(json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode(), data[at : at + 16], at + 16)


@dataclass
class Split(InputPartition):
    path: str
    start: int
    stop: int


def splits(path: str, split_bytes: int = SPLIT_BYTES) -> list[Split]:
    """The byte ranges of all files of a path."""
    _, found = files_of(path)
    root = path.split("://")[0] + "://" if "://" in path else ""
    return [Split(root + x.path if root else x.path, a, min(a + split_bytes, x.size)) for x in found for a in range(0, x.size, split_bytes)]


def _marker(source, at: int, stop: int, sync: bytes) -> int | None:
    """The first place from ``at`` to below ``stop`` at which a sync marker begins."""
    while at < stop:
        source.seek(at)
        data = source.read(min(CHUNK, stop - at) + len(sync) - 1)
        found = data.find(sync)
        if found >= 0:
            return at + found
        if len(data) < len(sync):
            return None
        at += len(data) - len(sync) + 1
    return None


def blocks(split: Split) -> Iterator[tuple[Header, int, bytes]]:
    """(header, number of records, their bytes) of a split's blocks."""
    system, (info,) = files_of(split.path)
    header = read_header(system, info.path)
    unpack = CODECS[header.codec][1] if header.codec in CODECS else None
    if unpack is None:
        raise ValueError(f"no codec {header.codec}")
    with system.open_input_file(info.path) as source:
        at = _marker(source, max(split.start, header.length - 16), split.stop, header.sync)
        while at is not None and at < split.stop and at + 16 < info.size:
            source.seek(at + 16)
            head = source.read(20)  # two numbers of ten bytes at most
            n, used = get_long(head, 0)
            size, used = get_long(head, used)
            source.seek(at + 16 + used)
            data = source.read(size + 16)
            if len(data) < size + 16 or data[size:] != header.sync:
                raise ValueError(f"{split.path} is damaged at {at + 16}")
            yield header, n, unpack(data[:size])
            at += 16 + used + size


class AvroReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, split_bytes: int):
        self.path, self.fields, self.split_bytes = path, schema, split_bytes

    def partitions(self) -> list[InputPartition]:
        return splits(self.path, self.split_bytes)

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        arrow, names = to_arrow_schema(self.fields), self.fields.names
        rows: list[dict] = []
        decode = None

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], f.type) for n, f in zip(names, arrow, strict=True)], schema=arrow)

        for header, n, data in blocks(split):
            decode, at = decode or decoder(header.schema), 0
            for _ in range(n):
                row, at = decode(data, at)
                rows.append(row if isinstance(row, dict) else {"value": row})
                if len(rows) == BATCH_ROWS:
                    yield batch()
                    rows.clear()
        if rows:
            yield batch()


# writing


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class RollingWriter(DataSourceWriter):
    """Files of a task, each closed before ``roll_bytes`` are passed or when it has ``roll_records``. Subclasses say how a file begins, how a row becomes bytes and how bytes that are held become a block."""

    suffix = ""

    def __init__(self, path: str, schema: StructType, overwrite: bool, options: dict[str, str]):
        self.path, self.fields, self.overwrite = path, schema, overwrite
        self.roll_bytes, self.roll_records = int(options.get("rollbytes", 1 << 60)), int(options.get("rollrecords", 1 << 60))

    def begin(self) -> tuple[bytes, Encoder, Callable[[int, bytearray], bytes], int]:
        """(head of a file, what appends a row, what makes a block of so many rows' bytes, bytes of a full block)."""
        raise NotImplementedError

    def write(self, rows: Iterator) -> Written:
        system, top = system_of(self.path)
        system.create_dir(top, recursive=True)
        done: list[tuple[str, str]] = []
        head, put, block, full = self.begin()
        held, n, out, size, records = bytearray(), 0, None, 0, 0

        def start() -> None:
            nonlocal out, size, records, head, put, block, full
            if out is not None:
                out.close()
                head, put, block, full = self.begin()
            name = f"part-{uuid.uuid4().hex}{self.suffix}"
            done.append((f"{top}/.{name}", f"{top}/{name}"))
            out, size, records = system.open_output_stream(done[-1][0]), len(head), 0
            out.write(head)

        def flush() -> None:
            nonlocal n, size, records
            if not n:
                return
            if out is None:
                start()
            data = block(n, held)
            if records and size + len(data) > self.roll_bytes:
                start()
                data = block(n, held)  # of the new file
            out.write(data)
            size, records = size + len(data), records + n
            held.clear()
            n = 0

        for row in rows:
            put(held, row)
            n += 1
            if len(held) >= full or records + n >= self.roll_records:
                flush()
            if records >= self.roll_records:
                out.close()
                out, records = None, 0
                head, put, block, full = self.begin()
        flush()
        if out is not None:
            out.close()
        return Written(done)

    def commit(self, messages: list[Written]) -> None:
        system, top = system_of(self.path)
        new = {b for m in messages if m for _, b in m.files}
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(top, allow_not_found=True)):
                if x.type == fs.FileType.File and x.base_name.startswith("part-") and x.path not in new:
                    system.delete_file(x.path)
        for m in messages:
            for temporary, final in m.files if m else []:
                system.move(temporary, final)

    def abort(self, messages: list[Written]) -> None:
        system, _ = system_of(self.path)
        for m in messages:
            for temporary, _ in m.files if m else []:
                if system.get_file_info(temporary).type == fs.FileType.File:
                    system.delete_file(temporary)


class AvroWriter(RollingWriter):
    suffix = ".avro"

    def __init__(self, path: str, schema: StructType, overwrite: bool, options: dict[str, str]):
        super().__init__(path, schema, overwrite, options)
        self.codec, self.block_bytes = options.get("codec", "deflate"), int(options.get("blockbytes", BLOCK_BYTES))
        if self.codec not in CODECS:
            raise ValueError(f"no codec {self.codec}")
        self.avro = json.dumps(schema_of(schema))

    def begin(self) -> tuple[bytes, Encoder, Callable[[int, bytearray], bytes], int]:
        sync, head = os.urandom(16), bytearray(MAGIC)
        put_long(head, 2)
        for key, value in (("avro.schema", self.avro), ("avro.codec", self.codec)):
            for x in (key.encode(), value.encode()):
                put_long(head, len(x))
                head += x
        head.append(0)
        pack = CODECS[self.codec][0]

        def block(n: int, held: bytearray) -> bytes:
            out, data = bytearray(), pack(bytes(held))
            put_long(out, n)
            put_long(out, len(data))
            return bytes(out) + data + sync

        return bytes(head) + sync, encoder(self.fields), block, self.block_bytes


class AvroSource(DataSource):
    """``path``; options splitBytes to read, codec, blockBytes, rollBytes and rollRecords to write."""

    @classmethod
    def name(cls) -> str:
        return "tidewater_avro"

    def schema(self) -> StructType:
        system, found = files_of(self.options["path"])
        if not found:
            raise FileNotFoundError(self.options["path"])
        kind = avro_type(read_header(system, found[0].path).schema)
        return kind if isinstance(kind, StructType) else StructType().add("value", kind)

    def reader(self, schema: StructType) -> DataSourceReader:
        return AvroReader(self.options["path"], schema, int(self.options.get("splitbytes", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return AvroWriter(self.options["path"], schema, overwrite, {k.lower(): v for k, v in self.options.items()})
