"""Progress of streaming queries as rows, and a sliding reservoir of values."""

from __future__ import annotations

import json
import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class ProgressReporter(StreamingQueryListener):
    """Hands a snapshot (header and metrics) of each micro-batch to a function, such as one that writes it to a sink."""

    def __init__(self, report: Callable[[dict], None]):
        self.report = report

    def onQueryStarted(self, event) -> None:
        self.report({"header": {"query": str(event.id), "name": event.name, "event": "started"}, "metrics": {}})

    def onQueryProgress(self, event) -> None:
        progress = json.loads(event.progress.json)
        metrics = {k: progress.get(k) for k in ("batchId", "numInputRows", "inputRowsPerSecond", "processedRowsPerSecond", "durationMs", "stateOperators", "eventTime")}
        self.report({"header": {"query": progress["id"], "name": progress.get("name"), "event": "progress", "time": progress["timestamp"]}, "metrics": metrics})

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None:
        self.report({"header": {"query": str(event.id), "event": "terminated", "error": event.exception}, "metrics": {}})


def report_to(spark: SparkSession, report: Callable[[dict], None]) -> ProgressReporter:
    listener = ProgressReporter(report)
    spark.streams.addListener(listener)
    return listener


class SlidingReservoir:
    """Values of the last ``window_ms``; a snapshot has count, min, max, average and percentiles."""

    def __init__(self, window_ms: int = 300_000, clock: Callable[[], float] = time.time):
        self.window, self.clock, self.held = window_ms / 1000, clock, deque()

    def _trim(self) -> None:
        while self.held and self.held[0][0] <= self.clock() - self.window:
            self.held.popleft()

    def update(self, value: float) -> None:
        self._trim()
        self.held.append((self.clock(), value))

    def snapshot(self, percentiles: tuple[float, ...] = (0.5, 0.99)) -> dict[str, float]:
        self._trim()
        values = sorted(v for _, v in self.held)
        if not values:
            return {"count": 0}
        out = {"count": len(values), "min": values[0], "max": values[-1], "avg": sum(values) / len(values)}
        return out | {f"p{p:g}": values[min(len(values) - 1, int(p * len(values)))] for p in percentiles}
