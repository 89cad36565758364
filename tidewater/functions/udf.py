"""User-defined functions by name, with a configuration of their own.

A function is a class with ``execute`` and, if it likes, ``init(config)``; its name in
SQL is the class's name without a trailing ``udf``. It sees nulls. One instance serves
each Python worker. ``vectorized`` functions take and return pandas series (Arrow
batches); use them for all but tiny inputs, and a built-in expression where one exists.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

from ..session import ship_package


@dataclass
class Udf:
    name: str
    kind: type
    returns: DataType | str
    vectorized: bool = False


def udf(returns: DataType | str = StringType(), name: str | None = None, vectorized: bool = False) -> Callable[[type], type]:
    """Mark a class as a user-defined function."""

    def mark(kind: type) -> type:
        kind._tw_udf = Udf(name or _name(kind.__name__), kind, returns, vectorized)
        return kind

    return mark


def _name(text: str) -> str:
    return text[:-3] if text.lower().endswith("udf") and len(text) > 3 else text


_instances: dict[tuple[str, str, frozenset], object] = {}


def _call(kind: type, config: dict[str, str]) -> Callable:
    def run(*args):
        key = (kind.__module__, kind.__qualname__, frozenset(config.items()))
        if key not in _instances:
            made = kind()
            if hasattr(made, "init"):
                made.init(dict(config))
            _instances[key] = made
        return _instances[key].execute(*args)

    return run


@dataclass
class UdfRegistry:
    """``config`` has keys ``<Name>.<option>``; each function gets its own options."""

    config: dict[str, str] = field(default_factory=dict)
    known: dict[str, Udf] = field(default_factory=dict)

    def add(self, kind: type) -> Udf:
        found = getattr(kind, "_tw_udf", None) or Udf(_name(kind.__name__), kind, StringType())
        if not callable(getattr(kind, "execute", None)):
            raise ValueError(f"{kind.__name__} has no execute method")
        self.known[found.name] = found
        return found

    def register(self, spark: SparkSession) -> None:
        import pandas as pd

        ship_package(spark)
        for found in self.known.values():
            own = {k[len(found.name) + 1 :]: v for k, v in self.config.items() if k.startswith(found.name + ".")}
            call = _call(found.kind, own)
            if found.vectorized:

                def batch(*args: pd.Series, call=call) -> pd.Series:
                    return call(*args)

                spark.udf.register(found.name, F.pandas_udf(batch, found.returns, F.PandasUDFType.SCALAR))
            else:
                spark.udf.register(found.name, call, found.returns)


def regex_match(pattern: str, text: Column) -> Column:
    """Whether all of a text matches a pattern; evaluated by Spark itself."""
    return text.rlike(f"^(?:{pattern})$")
