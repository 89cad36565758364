"""The stream interface: row transforms, exchange, joins, windows and triggers."""

from .exchange import group_tasks, partition_count, partitions_in, partitions_matching
from .joins import latest_join
from .stream import Graph, Stream
from .triggers import Count, Repeat, SinceFirst, SinceLast, any_of, count, repeat, since_first, since_last
from .windows import Collect, Fold, Partial, Window, count_rows, hopping_window, least_of, most_of, session_window, sum_of, tumbling_window

__all__ = [
    "Collect", "Count", "Fold", "Graph", "Partial", "Repeat", "SinceFirst", "SinceLast", "Stream", "Window",
    "any_of", "count", "count_rows", "group_tasks", "hopping_window", "latest_join", "least_of", "most_of", "partition_count", "partitions_in", "partitions_matching", "repeat", "session_window", "since_first", "since_last", "sum_of", "tumbling_window",
]
