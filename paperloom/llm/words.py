"""Vectorised word splitting and hashing of Arrow text columns, used inside Spark tasks.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return: `[^\\x20\\x09-\\x0D]+`. Texts are taken whole; null counts as empty.
Hashes have 64 bits and depend on the bytes alone.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK_BYTES + 2), base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if n <= 8 * BLOCK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` consecutive values; windows may span documents."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    if width <= 6:
        total = np.zeros(n, dtype=np.uint64)
        for j in range(width):
            total += values[j : j + n] * np.uint64(pow(_BASE, j + 1, 1 << 64))
        return mix(total)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _power(_BASE, len(values)), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * _power(_BASE_INVERSE, n))


@dataclass
class Block:
    """Some rows of a text column, with where their words are."""

    data: np.ndarray  # all bytes
    row_start: np.ndarray  # of each row, in bytes
    row_end: np.ndarray
    word_start: np.ndarray  # of each word, in bytes
    word_end: np.ndarray
    first_word: np.ndarray  # of each row, and past the last

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first_word)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.row_start)), self.n_words)

    def sums(self) -> np.ndarray:
        """Prefix sums for `span_hashes`, of the bytes as they are."""
        return _prefix(self.data)

    def span_hashes(self, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
        sums = _prefix(_LOWER[self.data] if lower else self.data)
        return mix((sums[end] - sums[start]) * _power(_BASE_INVERSE, len(self.data) + 1)[start])

    def word_hashes(self, lower: bool = False) -> np.ndarray:
        return self.span_hashes(self.word_start, self.word_end, lower)

    def window_rows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the windows that lie within one row, and their rows."""
        rows = self.row_of_word()
        n = len(rows) - width + 1
        if n <= 0:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        at = np.flatnonzero(rows[:n] == rows[width - 1 :])
        return at, rows[at]

    def count_bytes(self, flags: np.ndarray) -> np.ndarray:
        """Per row, the flagged bytes."""
        sums = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.row_end] - sums[self.row_start]


def _prefix(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[data] * _power(_BASE, len(data)), out=sums[1:])
    return sums


def as_large_string(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.cast(pa.large_string()).fill_null("")


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    """Cut a column into runs of rows of about `limit` bytes; a longer text is a block of its own."""
    column = as_large_string(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        high = min(high, len(column))
        yield low, high, split(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        low = high


def split(data: np.ndarray, offsets: np.ndarray) -> Block:
    start, end = offsets[:-1], offsets[1:]
    inside = ~_SEPARATOR[data]
    n = len(data)
    begins, ends = inside.copy(), inside.copy()
    if n:
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut = start[(start > 0) & (start < n)]
        begins[cut] = inside[cut]
        ends[cut - 1] = inside[cut - 1]
    word_start, word_end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(word_start, offsets)
    return Block(data, start, end, word_start, word_end, first)


def inside_words(block: Block) -> np.ndarray:
    return ~_SEPARATOR[block.data]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), dtype=bool)
    twice = twice[np.concatenate(([True], twice[1:] != twice[:-1]))]
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def release_memory() -> None:
    """Return what this Python worker holds unused: it stays alive beside the workers of other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
