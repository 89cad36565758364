"""Hadoop sequence files, written as a Spark data source in Python; files roll before a number of bytes is passed.

    df.select("key", "value").write.format("tidewater_sequence").option("rollBytes", 1 << 27).save(path)
    spark.sparkContext.sequenceFile(path)

The first column is the key and the second the value, each a string (Text), binary
(BytesWritable), int, long, float, double or boolean (their Writable); nulls are empty or 0. Records aren't
compressed; a sync marker stands before every block, so the files can be split.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Callable

from pyspark.sql.datasource import DataSource, DataSourceWriter
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructType

from .avro import Encoder, RollingWriter

BLOCK_BYTES = 2000


def _vint(n: int) -> bytes:
    """A length as the format's variable number."""
    if -112 <= n <= 127:
        return struct.pack("b", n)
    size = (n.bit_length() + 7) // 8
    return struct.pack("b", -112 - size) + n.to_bytes(size, "big")


def _text(value: str | None) -> bytes:
    data = (value or "").encode()
    return _vint(len(data)) + data


def _blob(value: bytes | None) -> bytes:
    return struct.pack(">i", len(value or b"")) + bytes(value or b"")


#: Class and bytes of a column type.
WRITABLE: dict[type, tuple[str, Callable[[object], bytes]]] = {
    StringType: ("Text", _text),
    BinaryType: ("BytesWritable", _blob),
    IntegerType: ("IntWritable", lambda v: struct.pack(">i", v or 0)),
    LongType: ("LongWritable", lambda v: struct.pack(">q", v or 0)),
    FloatType: ("FloatWritable", lambda v: struct.pack(">f", v or 0)),
    DoubleType: ("DoubleWritable", lambda v: struct.pack(">d", v or 0)),
    BooleanType: ("BooleanWritable", lambda v: b"\x01" if v else b"\x00"),
}


class SequenceWriter(RollingWriter):
    suffix = ".seq"

    def __init__(self, path: str, schema: StructType, overwrite: bool, options: dict[str, str]):
        super().__init__(path, schema, overwrite, options)
        if len(schema) != 2 or any(type(f.dataType) not in WRITABLE for f in schema):
            raise ValueError("a sequence file has a key and a value of simple types")

    def begin(self) -> tuple[bytes, Encoder, Callable[[int, bytearray], bytes], int]:
        (key_class, key), (value_class, value) = (WRITABLE[type(f.dataType)] for f in self.fields)
        sync = os.urandom(16)
        names = b"".join(_text(f"org.apache.hadoop.io.{x}") for x in (key_class, value_class))
        head = b"SEQ\x06" + names + b"\x00\x00" + struct.pack(">i", 0) + sync  # neither compression; no metadata

        def put(out: bytearray, row: tuple) -> None:
            a, b = key(row[0]), value(row[1])
            out += struct.pack(">ii", len(a) + len(b), len(a)) + a + b

        return head, put, lambda n, held: struct.pack(">i", -1) + sync + bytes(held), BLOCK_BYTES


class SequenceSource(DataSource):
    """``path``; options rollBytes and rollRecords."""

    @classmethod
    def name(cls) -> str:
        return "tidewater_sequence"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return SequenceWriter(self.options["path"], schema, overwrite, {k.lower(): v for k, v in self.options.items()})
