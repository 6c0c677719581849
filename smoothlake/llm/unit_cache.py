"""Ids of text units, such as words, that each worker keeps between batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Gives the ids of units, by their positions in a list, as one array, and how many each has.
Encode = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


class UnitCache:
    """Flat arrays of ids: a large table and a small one of newer units, each in order of the units' hashes.

    Memory is bounded: beyond so many units the tables start anew.
    """

    def __init__(self, most: int = 1_500_000, chunk: int = 4096):
        self.most, self.chunk = most, chunk
        self.clear()

    def clear(self) -> None:
        empty = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.tables = [empty, empty]
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def __len__(self) -> int:
        return sum(len(t[0]) for t in self.tables)

    def _add(self, flat: np.ndarray) -> int:
        first = self.used
        self.used += len(flat)
        if self.used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), np.uint32)])
        self.ids[first : self.used] = flat
        return first

    def lookup(self, keys: np.ndarray, encode: Encode) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of distinct keys, in order, begin in self.ids, and how many there are."""
        if len(self) + len(keys) > self.most:
            self.clear()
        at, n = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int32)
        for k, a, c in self.tables:
            if len(k):
                x = np.minimum(np.searchsorted(k, keys), len(k) - 1)
                good = k[x] == keys
                at[good], n[good] = a[x[good]], c[x[good]]
        new = np.flatnonzero(at < 0)
        for i in range(0, len(new), self.chunk):
            part = new[i : i + self.chunk]
            flat, size = encode(part)
            n[part] = size
            at[part] = self._add(flat) + np.cumsum(size, dtype=np.int64) - size
        if len(new):
            self.tables[1] = self._merged(self.tables[1], (keys[new], at[new], n[new]))
            if len(self.tables[1][0]) > 0.25 * len(self.tables[0][0]):
                self.tables = [self._merged(*self.tables), tuple(x[:0] for x in self.tables[0])]
        return at, n

    def spread(self, keys: np.ndarray, encode: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all keys, one after another, and where each key's begin, with the end of the last. encode() also gets a place of each distinct key."""
        distinct, one, which = np.unique(keys, return_index=True, return_inverse=True)
        at, n = self.lookup(distinct, lambda part: encode(part, one))
        size = n[which].astype(np.int64)
        bounds = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=bounds[1:])
        source = np.repeat(at[which] - bounds[:-1], size)
        source += np.arange(bounds[-1])
        return self.ids[source], bounds

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        place = np.searchsorted(a[0], b[0])
        return tuple(np.insert(x, place, y) for x, y in zip(a, b, strict=True))
