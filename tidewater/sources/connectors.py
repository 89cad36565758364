"""Options and messages for connectors whose jars a cluster adds: Kafka, Event Hubs, Kinesis, Elasticsearch, Avro.

Nothing here opens a connection. A reader is ``spark.readStream.format("kafka").options(**kafka_source(...))``;
a sink is ``format_sink("kafka", **options)`` over ``kafka_messages(...)``.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DoubleType, FloatType, IntegerType, LongType, MapType, NullType, StringType, StructField, StructType

from .catalog import KEY, keyed_partition

#: Where a stream without a checkpoint begins, by either name.
STARTS = {"oldest": "earliest", "earliest": "earliest", "upcoming": "latest", "latest": "latest"}
_PLACES = {"earliest": -2, "latest": -1}


def _start(name: str) -> str:
    if name not in STARTS:
        raise ValueError(f"no start {name}: one of {', '.join(STARTS)}")
    return STARTS[name]


def kafka_offsets(partitions: dict[str, int], default: str = "upcoming", streams: dict[str, str] | None = None, processed: dict[str, dict[int, int]] | None = None, reset: set[str] | None = None) -> str:
    """Starting offsets of each topic's partitions as JSON.

    A partition goes on after its last processed offset. Without one, or for a topic in
    ``reset``, it begins where ``streams`` says for its topic, or else at ``default``.
    """
    out: dict[str, dict[str, int]] = {}
    for topic, n in sorted(partitions.items()):
        place = _PLACES[_start((streams or {}).get(topic, default))]
        known = {} if topic in (reset or ()) else (processed or {}).get(topic, {})
        out[topic] = {str(p): known[p] + 1 if p in known else place for p in range(n)}
    return json.dumps(out)


def kafka_source(servers: str, topics: list[str] | None = None, pattern: str | None = None, start: str = "upcoming", offsets: str | None = None, batch: int | None = None, **more: str) -> dict[str, str]:
    """Options of a Kafka reader over named topics, or over all whose whole name matches a pattern (new ones too)."""
    if bool(topics) == bool(pattern):
        raise ValueError("either topics or a pattern")
    if pattern:
        re.compile(pattern)
    chosen = {"subscribePattern": pattern} if pattern else {"subscribe": ",".join(topics)}
    limit = {"maxOffsetsPerTrigger": str(batch)} if batch else {}
    return {"kafka.bootstrap.servers": servers, **chosen, "startingOffsets": offsets or _start(start), **limit, **more}


def matching_topics(topics: list[str], pattern: str, **settings: str) -> dict[str, dict[str, str]]:
    """The topics whose whole name matches, each with the same settings."""
    return {t: dict(settings) for t in sorted(topics) if re.fullmatch(pattern, t)}


def event_hubs_source(namespace: str, hub: str, connection: str, start: str = "upcoming") -> dict[str, str]:
    """Options of a Kafka reader for an event hub, which speaks Kafka's protocol."""
    login = f'org.apache.kafka.common.security.plain.PlainLoginModule required username="$ConnectionString" password="{connection}";'
    return kafka_source(f"{namespace}.servicebus.windows.net:9093", [hub], start=start, **{"kafka.security.protocol": "SASL_SSL", "kafka.sasl.mechanism": "PLAIN", "kafka.sasl.jaas.config": login})


def kinesis_source(region: str, stream: str, start: str = "upcoming") -> dict[str, str]:
    """Options of a Kinesis reader (format ``aws-kinesis``)."""
    return {"kinesis.region": region, "kinesis.streamName": stream, "kinesis.endpointUrl": f"https://kinesis.{region}.amazonaws.com", "kinesis.startingposition": {"earliest": "TRIM_HORIZON", "latest": "LATEST"}[_start(start)]}


def kafka_messages(df: DataFrame, topic: str, key: str = KEY, partition_key: str | None = None, partitions: int | None = None) -> DataFrame:
    """topic, key, value (the other columns in JSON) and, if their number is given, the partition that ``partition_key`` (or the key) names."""
    rest = [c for c in df.columns if c != key]
    dealt = [keyed_partition(partition_key or key, partitions).alias("partition")] if partitions else []
    return df.select(F.lit(topic).alias("topic"), F.col(key).cast("string").alias("key"), F.to_json(F.struct(*rest)).alias("value"), *dealt)


def index_requests(df: DataFrame, target: str, id_col: str | None = KEY, routing: str | None = None) -> DataFrame:
    """Index requests: index and type from ``index/type``, id, routing and the document in JSON; a row without an id gets none."""
    parts = target.split("/")
    if len(parts) != 2 or not all(parts):
        raise ValueError(f"{target}: index/type")
    rest = [c for c in df.columns if c != id_col]
    text = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    return df.select(F.lit(parts[0]).alias("index"), F.lit(parts[1]).alias("type"), text(id_col).alias("id"), text(routing).alias("routing"), F.to_json(F.struct(*rest)).alias("source"))


_SIMPLE: dict[str, DataType] = {
    "null": NullType(), "boolean": BooleanType(), "int": IntegerType(), "long": LongType(), "float": FloatType(), "double": DoubleType(),
    "bytes": BinaryType(), "fixed": BinaryType(), "string": StringType(), "enum": StringType(),
}


def avro_type(schema: str | dict | list) -> DataType:
    """The type of an Avro schema (JSON text or parsed); every field may be null.

    A union with null is its other branch, any other union is text; a record inside itself
    has no type and raises.
    """
    if isinstance(schema, str) and schema.lstrip()[:1] in ("{", "[", '"'):
        schema = json.loads(schema)
    return _avro(schema, {}, ())


def _avro(schema, named: dict, inside: tuple[str, ...]) -> DataType:
    if isinstance(schema, list):
        own = [x for x in schema if x != "null"]
        if len(own) != 1:
            for x in own:  # a type that is named here may be used further on
                _avro(x, named, inside)
            return StringType() if own else NullType()
        return _avro(own[0], named, inside)
    if isinstance(schema, str):
        if schema in inside:
            raise ValueError(f"record {schema} holds itself")
        if schema not in _SIMPLE and schema not in named:
            raise ValueError(f"no type {schema}")
        return named.get(schema) or _SIMPLE[schema]
    kind = schema["type"]
    if kind == "record":
        inner = (*inside, schema["name"])
        out: DataType = StructType([StructField(f["name"], _avro(f["type"], named, inner)) for f in schema["fields"]])
    elif kind == "array":
        return ArrayType(_avro(schema["items"], named, inside))
    elif kind == "map":
        return MapType(StringType(), _avro(schema["values"], named, inside))
    else:
        out = _avro(kind, named, inside)
    if "name" in schema:
        named[schema["name"]] = out
    return out
