"""A compressed FM-index over integer sequences: wavelet matrix of the Burrows-Wheeler transform, searched in lockstep.

Backward search keeps an interval of suffixes; common-prefix lengths of neighbouring suffixes widen it
where a match must give up its last symbols, and least values over intervals tell whose suffixes it holds.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Bits in 64-bit words with a count before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits) // 64 + 1
        padded = np.zeros(n * 64, dtype=bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words)[:-1], dtype=np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, n_symbols: int) -> None:
        self.n_levels = max(1, int(n_symbols - 1).bit_length())
        self.levels: list[tuple[BitVector, int]] = []
        for level in range(self.n_levels - 1, -1, -1):
            bits = (symbols >> level) & 1 == 1
            self.levels.append((BitVector(bits), int(len(bits) - bits.sum())))
            symbols = np.concatenate((symbols[~bits], symbols[bits]))
        first = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
        self.start = np.zeros(n_symbols, dtype=np.int64)
        self.start[symbols[first]] = first

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        for k, (bits, zeros) in enumerate(self.levels):
            ones = bits.rank(at)
            at = np.where((symbol >> (self.n_levels - 1 - k)) & 1 == 1, zeros + ones, at - ones)
        return at - self.start[symbol]


def suffix_ranks(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ordered by their first symbols, at least `depth` of them; and which begin with other first `depth` symbols than the one before.

    Prefix doubling: a suffix's rank by 2k symbols is that of the ranks by k at it and k later.
    """
    n = len(text)
    rank, width = text.astype(np.int64), 1
    powers = {1: rank}
    while width < depth:
        later = np.zeros(n, dtype=np.int64)
        later[: n - width] = rank[width:] + 1
        rank = np.unique(rank * (n + 2) + later, return_inverse=True)[1]
        width *= 2
        powers[width] = rank
    order = np.argsort(rank, kind="stable")
    # equality of the first `depth` symbols, from two overlapping widths
    half = width // 2 if width > depth else width
    a = powers[half][order]
    shifted = np.zeros(n, dtype=np.int64)
    shifted[: n - (depth - half)] = powers[half][depth - half :] + 1
    b = shifted[order]
    return order, np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))


class Minima:
    """Least values of ranges, from minima of all runs of 1, 2, 4, ... values."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values]
        while 2 << len(self.levels) - 1 <= len(values):
            last, half = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of low:high, which are not empty."""
        out = np.empty(len(low), dtype=self.levels[0].dtype)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            mine = np.flatnonzero(level == k)
            values = self.levels[k]
            out[mine] = np.minimum(values[low[mine]], values[high[mine] - (1 << int(k))])
        return out

    def run_before(self, at: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """The least place from which on all values up to and with `at` reach the floor; `at` + 1 if its own does not."""
        at = at + 1
        for k in range(len(self.levels) - 1, -1, -1):
            step = 1 << k
            ahead = at - step
            ok = ahead >= 0
            ok[ok] = self.levels[k][ahead[ok]] >= floor[ok]
            at = np.where(ok, ahead, at)
        return at

    def run_behind(self, at: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """The first place from `at` on whose value is below the floor, or the number of values."""
        n = len(self.levels[0])
        for k in range(len(self.levels) - 1, -1, -1):
            ok = at + (1 << k) <= n
            ok[ok] = self.levels[k][at[ok]] >= floor[ok]
            at = np.where(ok, at + (1 << k), at)
        return at


class FMIndex:
    """Over texts of symbols 1.. that each end with a 0. Matches are measured up to `depth` symbols; `value` is given for each place."""

    def __init__(self, text: np.ndarray, n_symbols: int, depth: int, value: np.ndarray) -> None:
        order, _ = suffix_ranks(text, depth)
        self.n, self.depth, self.n_symbols = len(text), depth, n_symbols
        self.wavelet = WaveletMatrix(text[order - 1], n_symbols)
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n_symbols))[:-1]))
        self.values = Minima(value[order])
        self.common = Minima(self._common_prefixes(text, order))

    def _common_prefixes(self, text: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Of each suffix with the one before it in order, up to `depth`; 0 for the first."""
        out = np.zeros(self.n, dtype=np.uint8 if self.depth < 256 else np.int32)
        here, a, b = np.arange(1, self.n), order[1:], order[:-1]
        for k in range(self.depth):
            ok = (a + k < self.n) & (b + k < self.n)
            ok[ok] = text[a[ok] + k] == text[b[ok] + k]
            here, a, b = here[ok], a[ok], b[ok]
            out[here] = k + 1
        return out

    def _extended(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray, symbol: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The intervals of matches cut to `depth` symbols with one more before them, and whether these hold a suffix whose value is below."""
        whole = depth == 0
        low = np.where(whole, 0, self.common.run_before(low, depth) - 1)
        high = np.where(whole, self.n, self.common.run_behind(high, depth))
        both = self.wavelet.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        low, high = self.smaller[symbol] + both[: len(symbol)], self.smaller[symbol] + both[len(symbol) :]
        found = high > low
        found[found] = self.values.least(low[found], high[found]) < below[found]
        return low, high, found

    def statistics(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Matching statistics: at each place of the streamed texts, how many of the symbols from there on also stand, one after the other, where
        the value is below the text's own bound; `depth` at most. Symbols out of range stand nowhere.

        All texts go backwards in lockstep. Each holds the interval of its match; where one more symbol leaves nothing below the bound,
        the match gives up last symbols, as few as will do (found by halving, as fewer symbols never match less). Sizes must not ascend.
        """
        out = np.zeros(len(text), dtype=np.int64)
        low, high, length = np.zeros(len(starts), dtype=np.int64), np.full(len(starts), self.n, dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
        for step in range(int(sizes.max(initial=0))):
            active = int(np.searchsorted(-sizes, -step, side="left"))
            at = starts[:active] + sizes[:active] - 1 - step
            known = (text[at] > 0) & (text[at] < self.n_symbols)
            lanes = np.flatnonzero(known)
            gone = np.flatnonzero(~known)
            low[gone], high[gone], length[gone] = 0, self.n, 0
            symbol = text[at[lanes]]
            # the depth that holds, -1 for none; first what is there, then by halving below it
            best, top = np.full(len(lanes), -1, dtype=np.int64), np.minimum(length[lanes], self.depth - 1)
            a, b = np.zeros(len(lanes), dtype=np.int64), top.copy()
            new_low, new_high = np.zeros(len(lanes), dtype=np.int64), np.full(len(lanes), self.n, dtype=np.int64)
            rest, tried = np.arange(len(lanes)), top
            while len(rest):
                x, y, ok = self._extended(low[lanes[rest]], high[lanes[rest]], tried, symbol[rest], below[lanes[rest]])
                hit = rest[ok]
                best[hit], new_low[hit], new_high[hit] = tried[ok], x[ok], y[ok]
                a[hit], b[rest[~ok]] = tried[ok] + 1, tried[~ok] - 1
                rest = rest[a[rest] <= b[rest]]
                tried = (a[rest] + b[rest] + 1) // 2
            low[lanes], high[lanes], length[lanes] = new_low, new_high, best + 1
            out[at] = length[:active]
        return out
