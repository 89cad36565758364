"""Calls of an outside service for rows, several in flight, in order."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd


def async_batches(fn: Callable[[dict], dict | None], flight: int = 8, timeout_s: float | None = None, retries: int = 0, batch: int = 1024):
    """A function for ``Stream.map_batches``: ``fn`` for each row, at most ``flight`` calls at a time in a task.

    Results come in the rows' order, whichever call ends first; None drops a row. A row is read only
    when a call may begin, so what is held is ``flight`` rows and ``batch`` results. A call that
    fails is made again up to ``retries`` times; one that is not done ``timeout_s`` after it began
    raises, as does the last failure.
    """
    if flight < 1:
        raise ValueError("at least one call is in flight")

    def call(row: dict) -> dict | None:
        for left in range(retries, -1, -1):
            try:
                return fn(row)
            except Exception:
                if not left:
                    raise

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        held, out = deque(), []
        pool = ThreadPoolExecutor(flight)

        def take() -> None:
            """Wait for the oldest call."""
            began, future = held.popleft()
            result = future.result(None if timeout_s is None else max(0.0, began + timeout_s - time.monotonic()))
            if result is not None:
                out.append(result)

        try:
            for pdf in batches:
                for row in pdf.to_dict("records"):
                    if len(held) == flight:
                        take()
                    held.append((time.monotonic(), pool.submit(call, row)))
                    if len(out) >= batch:
                        yield pd.DataFrame(out)
                        out = []
            while held:
                take()
            if out:
                yield pd.DataFrame(out)
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return run
