"""Streams by name, where they are read from and written to."""

from .catalog import Catalog, Sink, Source
from .connectors import avro_type, event_hubs_source, index_requests, kafka_messages, kafka_offsets, kafka_source, kinesis_source, matching_topics
from .files import bucketed_writer, directory_partitions, rolling_writer, snapshot
from .serdes import SERDES, Serde, readable

__all__ = [
    "SERDES", "Catalog", "Serde", "Sink", "Source", "avro_type", "bucketed_writer", "directory_partitions", "event_hubs_source", "index_requests",
    "kafka_messages", "kafka_offsets", "kafka_source", "kinesis_source", "matching_topics", "readable", "rolling_writer", "snapshot",
]
