"""How a query ends: at the end of its input, or when one of its rows asks for it."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

#: A task's row whose column of this name is true asks that the query ends after its micro-batch.
SHUTDOWN = "_shutdown"


class _Stopper(StreamingQueryListener):
    """Stops a query once the micro-batch that asked for it is committed."""

    def __init__(self) -> None:
        self.asked: int | None = None
        self.done = threading.Event()

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        if self.asked is not None and event.progress.batchId >= self.asked:
            self.done.set()

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None:
        self.done.set()


def run_until_shutdown(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str = "0 seconds") -> StreamingQuery:
    """Run a query until a row asks for its end, and wait for it. ``write`` gets each micro-batch without the control column and with its number.

    The query goes on reading until then, so it can be started again from its checkpoint.
    """
    stopper = _Stopper()

    def each(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        try:
            write(batch.where(~F.coalesce(F.col(SHUTDOWN), F.lit(False))).drop(SHUTDOWN), n)
            if stopper.asked is None and not batch.where(F.col(SHUTDOWN)).isEmpty():
                stopper.asked = n
        finally:
            batch.unpersist()

    streams = rows.sparkSession.streams
    query = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    streams.addListener(stopper)
    try:
        while query.isActive and not stopper.done.wait(0.2):
            # The listener may have been added after the batch that asked.
            if stopper.asked is not None and (last := query.lastProgress) is not None and last.batchId >= stopper.asked:
                break
        if query.exception() is not None:
            raise query.exception()
        query.stop()
    finally:
        streams.removeListener(stopper)
    return query
