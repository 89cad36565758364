"""State as tables, and a time series over a key's state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_state(spark: SparkSession, checkpoint: str, variable: str | None = None, **options: str) -> DataFrame:
    """What a query's keyed state holds, from its checkpoint; ``variable`` names a state variable such as ``open``."""
    reader = spark.read.format("statestore").option("path", checkpoint).options(**options)
    return (reader.option("stateVarName", variable) if variable else reader).load()


class TimeSeries:
    """(key, time, sequence) to value over a ``TaskStore``: many values at one time keep their order.

    Entries are in order of their times, so ``put``, ``get`` and ``remove`` load only the
    buckets of the times that they name.
    """

    def __init__(self, store, overwrite: bool = False):
        self.store, self.overwrite = store, overwrite

    @staticmethod
    def _at(key: str, ms: int) -> str:
        if ms < 0:
            raise ValueError("times are not negative")
        return f"{key}\x00{ms:020d}\x00"

    def put(self, key: str, value: str, ms: int) -> None:
        at = self._at(key, ms)
        last = [] if self.overwrite else self.store.range(at, at[:-1] + "\x01")
        self.store.put(f"{at}{int(last[-1][0][len(at):]) + 1 if last else 0:020d}", value)

    def get(self, key: str, start: int, stop: int) -> list[tuple[int, str]]:
        """(time, value) from ``start`` to below ``stop``, in order."""
        found = self.store.range(self._at(key, start), self._at(key, stop)) if stop > start else []
        return [(int(k[len(key) + 1 :].split("\x00")[0]), v) for k, v in found]

    def remove(self, key: str, start: int, stop: int) -> None:
        if stop > start:
            self.store.delete_range(self._at(key, start), self._at(key, stop))
