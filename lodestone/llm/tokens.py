"""Token ids of text units (words with what clings to them), remembered between texts, batches and tasks of a worker."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from itertools import chain, islice

import numpy as np


def ragged(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices pool[start : start + length], end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def slices(flat: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """``flat`` cut into parts of the given sizes."""
    ends = np.cumsum(sizes).tolist()
    return [flat[i:j] for i, j in zip([0, *ends], ends, strict=False)]


class _Numbers(dict):
    """Units to numbers; an unknown one gets the next number."""

    def __missing__(self, unit: Hashable) -> int:
        self[unit] = n = len(self)
        return n


class UnitCache:
    """Ids of units. ``encode`` turns distinct units into their ids, end to end, and the number of each one's; at ``limit`` units all are forgotten."""

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], dtype, limit: int):
        self.encode, self.dtype, self.limit = encode, dtype, limit
        self.clear()

    def clear(self) -> None:
        self.numbers = _Numbers()
        self.known = self.used = 0
        self.starts = np.zeros(1 << 10, np.int64)
        self.lengths = np.zeros(1 << 10, np.int32)
        self.pool = np.zeros(1 << 12, self.dtype)

    def _learn(self) -> None:
        units = list(islice(reversed(self.numbers), len(self.numbers) - self.known))[::-1]
        for at in range(0, len(units), 50_000):
            flat, lengths = self.encode(units[at : at + 50_000])
            n, m = self.known, len(lengths)
            while n + m > len(self.starts):
                self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
            while self.used + len(flat) > len(self.pool):
                self.pool = np.resize(self.pool, 2 * len(self.pool))
            self.starts[n : n + m] = self.used + np.cumsum(lengths) - lengths
            self.lengths[n : n + m] = lengths
            self.pool[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
            self.known += m

    def ids(self, texts: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts' units, end to end, and the number of ids of each text."""
        if len(self.numbers) > self.limit:
            self.clear()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        flat = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
        if len(self.numbers) > self.known:
            self._learn()
        lengths = self.lengths[flat]
        total = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        ends = np.cumsum(sizes)
        return ragged(self.pool, self.starts[flat], lengths), total[ends] - total[ends - sizes]
