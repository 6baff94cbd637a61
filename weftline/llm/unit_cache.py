"""A bounded cache for encoders that work unit by unit (a unit: what no token crosses the ends of)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa


def runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each size, one after the other."""
    done = np.cumsum(size, dtype=np.int32)
    return np.repeat(start - (done - size), size) + np.arange(done[-1] if len(done) else 0, dtype=np.int32)


def joined(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of about ``size`` bytes: larger ones repeat more units, whose encoding is then looked up once."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


class UnitCache:
    """Encoded units of two generations. When the young one holds ``limit`` characters it becomes the old one, and
    what is still in use moves back; memory stays bounded and frequent units stay cached."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 4_000_000):
        self.encode, self.limit = encode, limit
        self.young: dict = {}
        self.old: dict = {}
        self.size = 0

    def peek(self, units: set) -> dict:
        """What is cached of ``units``."""
        return {u: (self.young if u in self.young else self.old)[u] for u in units if u in self.young or u in self.old}

    def clear(self) -> None:
        self.young, self.old, self.size = {}, {}, 0

    def add(self, found: dict) -> None:
        self.young.update(found)
        self.size += sum(map(len, found)) + 16 * len(found)

    def get(self, units: Sequence) -> list[bytes]:
        """Encoded ``units``, which are distinct."""
        young, old = self.young, self.old
        parts = list(map(young.get, units))
        fresh = []
        for i in [i for i, p in enumerate(parts) if p is None]:
            u = units[i]
            p = parts[i] = old.get(u)
            if p is None:
                fresh.append(i)
            else:
                young[u] = p
                self.size += len(u) + 16
        new = [units[i] for i in fresh]
        done = self.encode(new)
        for i, p in zip(fresh, done, strict=True):
            parts[i] = p
        self.add(dict(zip(new, done, strict=True)))
        if self.size > self.limit:
            self.old, self.young, self.size = self.young, {}, 0
        return parts
