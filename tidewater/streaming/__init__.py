"""Unbounded streams: keyed state, timers, triggered windows, end of stream, task interface, source and sink interfaces."""

from .calls import async_batches
from .metrics import ProgressReporter, SlidingReservoir, report_to
from .ordered import OrderedMap
from .runs import SHUTDOWN, run_until_shutdown
from .sources import QueueSource, TailSource, register_sources
from .state import TimeSeries, read_state
from .stateful import LatestJoin, Task, TaskStore, end_task, join_streams, run_task
from .time import flush_with_sentinel, replay, to_event_time
from .windows import TriggeredWindows, close_windows, window_stream

__all__ = [
    "SHUTDOWN", "LatestJoin", "OrderedMap", "ProgressReporter", "QueueSource", "SlidingReservoir", "TailSource", "Task", "TaskStore", "TimeSeries", "TriggeredWindows", "async_batches", "close_windows",
    "end_task", "flush_with_sentinel", "join_streams", "read_state", "register_sources", "replay", "report_to", "run_task", "run_until_shutdown", "to_event_time", "window_stream",
]
