"""Early triggers, as plain values and as a replay over the arrival times of one window."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Count:
    """Fires when the pane has ``n`` rows; once, unless repeated."""

    n: int


@dataclass(frozen=True)
class SinceFirst:
    """Fires a duration (ms) after the first row it sees."""

    ms: int


@dataclass(frozen=True)
class SinceLast:
    """Fires when no row came for a duration (ms)."""

    ms: int


@dataclass(frozen=True)
class AnyOf:
    triggers: tuple


@dataclass(frozen=True)
class Repeat:
    trigger: object


def count(n: int) -> Count:
    if n < 1:
        raise ValueError("a count is at least 1")
    return Count(n)


def since_first(ms: int) -> SinceFirst:
    return SinceFirst(ms)


def since_last(ms: int) -> SinceLast:
    return SinceLast(ms)


def any_of(*triggers) -> AnyOf:
    if not triggers:
        raise ValueError("any_of needs a trigger")
    return AnyOf(triggers)


def repeat(trigger) -> Repeat:
    return Repeat(trigger)


class Machine:
    """A trigger's state within one window: rows and the clock go in, firings come out."""

    def __init__(self, spec):
        self.spec = spec
        self.start()

    def start(self) -> None:
        self.seen, self.due, self.done = 0, None, False
        spec = self.spec
        self.parts = [Machine(x) for x in spec.triggers] if isinstance(spec, AnyOf) else [Machine(spec.trigger)] if isinstance(spec, Repeat) else []

    def next_due(self) -> int | None:
        if self.done:
            return None
        if self.parts:
            return min((d for d in (p.next_due() for p in self.parts) if d is not None), default=None)
        return self.due

    def _after(self, fired: bool) -> bool:
        if fired and isinstance(self.spec, Repeat):
            self.start()
        elif fired:
            self.done = True
        return fired

    def tick(self, now: int) -> bool:
        """Whether it fires when the clock reaches ``now``."""
        if self.done:
            return False
        if self.parts:
            return self._after(any([p.tick(now) for p in self.parts]))
        return self._after(self.due is not None and self.due <= now)

    def row(self, at: int) -> bool:
        """Whether a row makes it fire."""
        if self.done:
            return False
        if self.parts:
            return self._after(any([p.row(at) for p in self.parts]))
        self.seen += 1
        if isinstance(self.spec, SinceFirst) and self.due is None:
            self.due = at + self.spec.ms
        if isinstance(self.spec, SinceLast):
            self.due = at + self.spec.ms
        return self._after(isinstance(self.spec, Count) and self.seen >= self.spec.n)

    def dump(self) -> list:
        """The state as plain values, for ``load``."""
        return [self.seen, self.due, self.done, [p.dump() for p in self.parts]]

    def load(self, data: list) -> Machine:
        self.seen, self.due, self.done = data[:3]
        for part, own in zip(self.parts, data[3], strict=True):
            part.load(own)
        return self

    def merge(self, other: Machine) -> None:
        """Take in another window's state: rows add up, the first row's timer is the earlier one, the last row's the later, and what has fired for good stays so."""
        dues = [d for d in (self.due, other.due) if d is not None]
        self.due = (max if isinstance(self.spec, SinceLast) else min)(dues) if dues else None
        self.seen, self.done = self.seen + other.seen, self.done or other.done
        for part, own in zip(self.parts, other.parts, strict=True):
            part.merge(own)


def firings(spec, times: list[int], end: int) -> list[int]:
    """How many rows had come at each early firing before a window's end; times in order, in ms."""
    machine, out = Machine(spec), []

    def clock(limit: int, rows: int) -> None:
        while (due := machine.next_due()) is not None and due < limit:
            if machine.tick(due):
                out.append(rows)

    for i, t in enumerate(times):
        # A timer due at a row's own time fires before the row, which is then of the next pane.
        clock(t + 1, i)
        if machine.row(t):
            out.append(i + 1)
    clock(end, len(times))
    return out
