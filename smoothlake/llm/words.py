"""Vectorised word spans and 64-bit word hashes over Arrow text columns.

Texts are taken as UTF-8 bytes. A word is a maximal run of bytes outside a set of separator
bytes; the default set is the ASCII white space (space and 0x09 to 0x0D). Hashes are polynomial
in a table of random 64-bit numbers, taken modulo 2**64 and mixed, so that equal words have equal
hashes in every process.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
BLOCK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1 << 40, 1 << 62)) | 1
_STEP = int(_rng.integers(1 << 40, 1 << 62)) | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    if base not in _powers or len(_powers[base][0]) <= n:
        size = max(n + 1, BLOCK_BYTES + 1)
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            pair.append(np.cumprod(x))
        if size > 4 * BLOCK_BYTES:
            return tuple(pair)
        _powers[base] = tuple(pair)
    return _powers[base]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Block:
    """Some rows' texts as one array of bytes; bounds[i] to bounds[i + 1] is row i."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int):
        self.data, self.bounds, self.first, self.rows = data, bounds, first, len(bounds) - 1
        self._prefix: np.ndarray | None = None

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """The sum of a value of each byte, by row."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def spans(self, separators: np.ndarray = SPACES, data: np.ndarray | None = None, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and rows of the words; cuts are bytes at which a new word begins anyway."""
        data = self.data if data is None else data
        n = len(data)
        inside = ~separators[data]
        edge = np.zeros(n + 1, bool)
        if cuts is not None:
            edge[:n] = cuts
        edge[self.bounds] = True
        start = inside.copy()
        start[1:] &= ~inside[:-1] | edge[1:n]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | edge[1:n]
        starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        return starts, ends, np.searchsorted(self.bounds, starts, "right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray, data: np.ndarray | None = None) -> np.ndarray:
        """Hashes of spans."""
        n = len(self.data)
        power, inverse = _power(_BASE, n)
        if data is not None or self._prefix is None:
            prefix = np.zeros(n + 1, np.uint64)
            x = _TABLE[self.data if data is None else data]
            x *= power[:n]
            np.cumsum(x, out=prefix[1:])
            if data is None:
                self._prefix = prefix
        else:
            prefix = self._prefix
        h = prefix[ends]
        h -= prefix[starts]
        h *= inverse[starts]
        return mix(h)


def hash_word(word: bytes) -> int:
    """The hash that Block.hashes() gives this word."""
    total = 0
    for i, b in enumerate(word):
        total += int(_TABLE[b]) * pow(_BASE, i, 1 << 64)
    return int(mix(np.array([total & ((1 << 64) - 1)], np.uint64))[0])


def windows(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the windows of so many words within one row, and the hashes of the windows."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    power, inverse = _power(_STEP, len(hashes))
    prefix = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=prefix[1:])
    at = np.flatnonzero(rows[:n] == rows[size - 1 :])
    return at, mix((prefix[at + size] - prefix[at]) * inverse[at])


def with_row(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hashes that differ between rows."""
    return mix(hashes + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Where a key occurs twice or more."""
    s = np.sort(keys)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys


def as_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where its rows begin; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim
except (OSError, AttributeError):  # another C library
    _libc = None


def trim() -> None:
    """Gives freed memory back to the system: a worker lives on between tasks, beside others."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """All rows of a column, in blocks of about so many bytes; a longer text is a block of its own."""
    data, bounds = as_bytes(column)
    first, rows = 0, len(bounds) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + most, "right")) - 1)
        part = bounds[first : last + 1]
        yield Block(data[part[0] : part[-1]], part - part[0], first)
        first = last
    trim()
