"""An ordered map in a key's state: one directory of bounds, and buckets of sorted entries.

A read or write loads the directory and the bucket that its key falls into; a range loads
the buckets that it overlaps. Buckets split at ``SPLIT`` entries and go when they are
empty. What a call of the processor has loaded is kept until ``flush``, which writes
each changed bucket once. Keys are ordered by their bytes; values are bytes.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

#: Entries of a full bucket, which becomes two.
SPLIT = 512


class OrderedMap:
    """``begin`` and ``flush`` enclose what is done for one key of the stream."""

    def __init__(self, handle, name: str = "entries"):
        # Bounds are the buckets' least possible keys; the first is empty.
        self.directory = handle.getValueState(f"{name}_directory", "bounds array<binary>, ids array<bigint>, next bigint")
        self.buckets = handle.getMapState(f"{name}_buckets", "id bigint", "keys array<binary>, vals array<binary>")
        self.begin()

    def begin(self) -> None:
        self.bounds: list[bytes] | None = None
        self.ids: list[int] = []
        self.next = 0
        self.moved = False  # whether the directory has changed
        self.held: dict[int, tuple[list[bytes], list[bytes]]] = {}
        self.changed: set[int] = set()

    def _load(self) -> None:
        if self.bounds is None:
            found = self.directory.get() if self.directory.exists() else None
            self.bounds, self.ids, self.next = ([bytes(b) for b in found[0]], list(found[1]), found[2]) if found else ([], [], 0)

    def _bucket(self, place: int) -> tuple[list[bytes], list[bytes]]:
        i = self.ids[place]
        if i not in self.held:
            keys, values = self.buckets.getValue((i,))
            self.held[i] = [bytes(k) for k in keys], [bytes(v) for v in values]
        return self.held[i]

    def _place(self, key: bytes) -> int:
        return bisect_right(self.bounds, key) - 1

    def get(self, key: bytes) -> bytes | None:
        self._load()
        if not self.ids:
            return None
        keys, values = self._bucket(self._place(key))
        at = bisect_left(keys, key)
        return values[at] if at < len(keys) and keys[at] == key else None

    def put(self, key: bytes, value: bytes) -> None:
        self._load()
        if not self.ids:
            self.bounds, self.ids, self.next, self.moved = [b""], [0], 1, True
            self.held[0] = [], []
        place = self._place(key)
        keys, values = self._bucket(place)
        at = bisect_left(keys, key)
        if at < len(keys) and keys[at] == key:
            values[at] = value
        else:
            keys.insert(at, key)
            values.insert(at, value)
        self.changed.add(self.ids[place])
        if len(keys) >= SPLIT:
            # What only ever grows at its end leaves full buckets behind.
            half = len(keys) * 7 // 8 if at == len(keys) - 1 else len(keys) // 2
            self.held[self.next] = keys[half:], values[half:]
            self.bounds.insert(place + 1, keys[half])
            self.ids.insert(place + 1, self.next)
            self.changed.add(self.next)
            self.next, self.moved = self.next + 1, True
            del keys[half:], values[half:]

    def remove(self, key: bytes) -> None:
        self.remove_range(key, key + b"\x00")

    def remove_range(self, start: bytes, stop: bytes | None) -> None:
        """All entries from ``start`` to below ``stop`` (to the end without)."""
        for place in reversed(list(self._places(start, stop))):
            keys, values = self._bucket(place)
            a, b = bisect_left(keys, start), bisect_left(keys, stop) if stop is not None else len(keys)
            if a == b:
                continue
            del keys[a:b], values[a:b]
            i = self.ids[place]
            self.changed.add(i)
            if not keys:
                del self.bounds[place], self.ids[place]
                self.moved = True
                if place == 0 and self.bounds:
                    self.bounds[0] = b""

    def _places(self, start: bytes, stop: bytes | None) -> range:
        self._load()
        if not self.ids or stop is not None and stop <= start:
            return range(0)
        return range(self._place(start), bisect_left(self.bounds, stop) if stop is not None else len(self.ids))

    def range(self, start: bytes = b"", stop: bytes | None = None) -> Iterator[tuple[bytes, bytes]]:
        """Entries from ``start`` to below ``stop`` (to the end without), in order."""
        for place in self._places(start, stop):
            keys, values = self._bucket(place)
            a, b = bisect_left(keys, start), bisect_left(keys, stop) if stop is not None else len(keys)
            yield from list(zip(keys[a:b], values[a:b], strict=True))

    def flush(self) -> None:
        live = set(self.ids)
        for i in sorted(self.changed):
            if i in live:
                self.buckets.updateValue((i,), self.held[i])
            elif self.buckets.containsKey((i,)):
                self.buckets.removeKey((i,))
        if self.moved:
            if self.ids:
                self.directory.update((self.bounds, self.ids, self.next))
            else:
                self.directory.clear()
        self.changed.clear()
        self.moved = False
