"""Wire types as column expressions: bytes to values and back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

_BROKEN = "_tw_broken"


@dataclass(frozen=True)
class Serde:
    decode: Callable[[Column], Column]
    encode: Callable[[Column], Column]


def _big_endian(kind: str, width: int) -> Serde:
    """Two's complement, most significant byte first; other widths give null."""
    size = 2 * width

    def decode(x: Column) -> Column:
        raw = F.conv(F.hex(x), 16, 10).cast("decimal(20,0)")
        whole, half = (F.lit(str(2**n)).cast("decimal(20,0)") for n in (8 * width, 8 * width - 1))
        signed = F.when(raw >= half, raw - whole).otherwise(raw)
        return F.when(F.octet_length(x) == width, signed.cast(kind))

    def encode(x: Column) -> Column:
        return F.unhex(F.right(F.lpad(F.hex(x.cast("long")), F.lit(16), F.lit("0")), F.lit(size)))

    return Serde(decode, encode)


def string(charset: str = "UTF-8") -> Serde:
    return Serde(lambda x: F.decode(x, charset), lambda x: F.encode(x, charset))


def json(schema: str) -> Serde:
    """Records (or a map, an array) in JSON; a message that can't be read is null."""

    def decode(x: Column) -> Column:
        text, kind = x.cast("string"), DataType.fromDDL(schema)
        if not isinstance(kind, StructType):
            return F.from_json(text, kind)
        # What the parser can't read it puts into a column of its own.
        read = F.from_json(text, StructType([*kind.fields, StructField(_BROKEN, StringType())]), {"columnNameOfCorruptRecord": _BROKEN})
        return F.when(read.isNotNull() & read[_BROKEN].isNull(), F.struct(*[read[f.name].alias(f.name) for f in kind]))

    return Serde(decode, lambda x: F.to_json(x).cast("binary"))


def _double() -> Serde:
    """Eight bytes, most significant first, as Java's bits of a double."""
    bits = lambda x: F.when(x.isNotNull(), F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x).cast("long"))
    value = lambda x: F.when(x.isNotNull(), F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), x).cast("double"))
    return Serde(lambda x: value(_LONG.decode(x)), lambda x: _LONG.encode(bits(x.cast("double"))))


def readable(df: DataFrame, column: str, serde: Serde, observation: Observation | None = None) -> DataFrame:
    """Rows with a column decoded; those whose bytes can't be read are dropped, and counted as ``dropped`` by the observation (each time a job reads them: a sort reads twice). Null bytes stay."""
    out = df.withColumn("_tw_value", serde.decode(F.col(column)))
    bad = F.col(column).isNotNull() & F.col("_tw_value").isNull()
    if observation is not None:
        out = out.observe(observation, F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("dropped"))
    return out.where(~bad).select(*[F.col("_tw_value").alias(c) if c == column else F.col(c) for c in df.columns])


def keyed(key: Serde, value: Serde) -> Serde:
    """A struct of key and value, each with a serde of its own."""
    return Serde(
        lambda x: F.struct(key.decode(x["key"]).alias("key"), value.decode(x["value"]).alias("value")),
        lambda x: F.struct(key.encode(x["key"]).alias("key"), value.encode(x["value"]).alias("value")),
    )


def intercepted(serde: Serde, outward: Callable[[Column], Column], inward: Callable[[Column], Column]) -> Serde:
    """A serde whose bytes pass through a function on their way out and its inverse on their way in."""
    return Serde(lambda x: serde.decode(inward(x)), lambda x: outward(serde.encode(x)))


def encrypted(serde: Serde, key: str) -> Serde:
    """Bytes encrypted with AES in GCM mode; ``key`` has 16, 24 or 32 characters."""
    return intercepted(serde, lambda x: F.aes_encrypt(x, F.lit(key)), lambda x: F.aes_decrypt(x, F.lit(key)))


_LONG = _big_endian("long", 8)
_same = Serde(lambda x: x, lambda x: x)
SERDES: dict[str, Serde] = {
    "int": _big_endian("int", 4),
    "long": _LONG,
    "string": string(),
    "bytes": Serde(lambda x: x.cast("binary"), lambda x: x.cast("binary")),
    "noop": _same,
    # A UUID is 16 bytes; its text form is lower-case hex with dashes.
    "uuid": Serde(lambda x: F.regexp_replace(F.lower(F.hex(x)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), lambda x: F.unhex(F.replace(x, F.lit("-")))),
    "double": _double(),
    "json_map": json("map<string,string>"),
}
