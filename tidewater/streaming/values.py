"""Values of a stream's windows, as states that rows are added to.

Each has ``start``, ``add`` (with a row, a dict of its columns), ``merge`` (of two
sessions' states that a row joins) and ``result``. All but ``rows`` keep a state whose
size doesn't depend on how many rows came. Nulls are left out of sums, extremes and means.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


def _none(x) -> bool:
    return x is None or x != x  # a number's null comes as NaN


@dataclass(frozen=True)
class Value:
    ddl: str
    start: Callable[[], object]
    add: Callable[[object, dict], object]
    merge: Callable[[object, object], object] | None
    result: Callable[[object], object]
    columns: tuple[str, ...] = ()


def _same(x):
    return x


def _of(column: str, ddl: str, pick: Callable[[object, object], object]) -> Value:
    def merge(a, b):
        return b if a is None else a if b is None else pick(a, b)

    return Value(ddl, lambda: None, lambda state, row: state if _none(row[column]) else merge(state, row[column]), merge, _same, (column,))


def number() -> Value:
    """How many rows."""
    return Value("bigint", lambda: 0, lambda state, row: state + 1, lambda a, b: a + b, _same)


def total(column: str, ddl: str = "double") -> Value:
    """Their sum; null without any."""
    return _of(column, ddl, lambda a, b: a + b)


def least(column: str, ddl: str = "double") -> Value:
    return _of(column, ddl, min)


def most(column: str, ddl: str = "double") -> Value:
    return _of(column, ddl, max)


def mean(column: str) -> Value:
    def add(state, row):
        return state if _none(row[column]) else (state[0] + float(row[column]), state[1] + 1)

    return Value("double", lambda: (0.0, 0), add, lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: s[0] / s[1] if s[1] else None, (column,))


def rows(column: str, ddl: str) -> Value:
    """A column of all rows, in order of time and tie-breaker whatever order they came in; its state holds them."""

    def add(state: list, row: dict) -> list:
        state.append((row["tw_ms"], row["tw_tie"], row[column]))
        return state

    return Value(f"array<{ddl}>", list, add, lambda a, b: a + b, lambda s: [x[2] for x in sorted(s, key=lambda x: x[:2])], (column,))


def folded(start: object, add: Callable[[object, dict], object], ddl: str, columns: tuple[str, ...], merge: Callable[[object, object], object] | None = None) -> Value:
    """``add(state, row)`` over the rows in the order in which they come; sessions need ``merge``."""
    return Value(ddl, lambda: start, add, merge, _same, columns)
