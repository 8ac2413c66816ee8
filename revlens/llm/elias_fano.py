"""Elias-Fano sequences as numpy arrays that may lie in a mapped file.

Values are cut into l low bits, stored in a row, and a high part, stored as a bit vector
with a one for each value and a zero after all values of the same high part. A table of the
ones or zeros before each word of 64 bits leads to the n-th of them: ones lead to a value by
its place, zeros to a place by its value. All functions take whole arrays.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


def encode(values: np.ndarray, universe: int, by_value: bool) -> dict[str, np.ndarray]:
    """Ascending values below universe, repeats allowed; by_value: to be searched with find, else read with get."""
    n = len(values)
    low = max(0, (universe // max(n, 1)).bit_length() - 1)
    v = values.astype(U)
    words = np.zeros((n * low + 63) // 64 + 1, U)
    if low and n:
        part = v & U((1 << low) - 1)
        bit = np.arange(n, dtype=U) * U(low)
        at, shift = (bit >> U(6)).astype(np.int64), bit & U(63)
        np.bitwise_or.at(words, at, part << shift)
        over = np.flatnonzero(shift + U(low) > U(64))
        np.bitwise_or.at(words, at[over] + 1, part[over] >> (U(64) - shift[over]))
    high = (v >> U(low)).astype(np.int64)
    size = n + (universe >> low) + 1
    size += -size % 64
    bits = np.zeros(size, bool)
    bits[high + np.arange(n)] = True
    upper = np.packbits(bits, bitorder="little").view(U)
    ones = np.bitwise_count(upper).astype(np.int64)
    table = np.append(0, np.cumsum(64 - ones if by_value else ones))
    table = table.astype(np.uint32 if size < 1 << 32 else np.int64)
    return {"low": words, "high": upper, "table": table, "shape": np.array([n, low, by_value], np.int64)}


class Sequence:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.words, self.high, self.table = arrays["low"], arrays["high"], arrays["table"]
        self.n, self.low, self.by_value = (int(x) for x in arrays["shape"])

    def _select(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero (by_value) or one, counted from 0."""
        at = np.searchsorted(self.table, k.astype(self.table.dtype), "right") - 1
        rest = (k - self.table[at]).astype(np.uint8)
        left = ~self.high[at] if self.by_value else self.high[at]
        place = at * 64
        for half in (32, 16, 8, 4, 2, 1):
            ones = np.bitwise_count(left & U((1 << half) - 1))
            up = rest >= ones
            rest = rest - ones * up
            left = left >> (up * U(half))
            place += up * half
        return place

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), U)
        bit = i.astype(U) * U(self.low)
        at, shift = (bit >> U(6)).astype(np.int64), bit & U(63)
        above = np.where(shift > 0, self.words[at + 1] << ((U(64) - shift) & U(63)), U(0)) if self.low > 1 else U(0)
        return (self.words[at] >> shift | above) & U((1 << self.low) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        return ((self._select(i) - i).astype(U) << U(self.low)) | self._low(i)

    def find(self, values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place of each value within [begin, end), or -1: the search for the successor, which must equal it."""
        v = values.astype(U)
        high, low = (v >> U(self.low)).astype(np.int64), v & U((1 << self.low) - 1)
        lo = np.where(high > 0, self._select(np.maximum(high - 1, 0)) - high + 1, 0)
        hi = np.minimum(self._select(high) - high, end)  # values of this high part lie in [lo, hi)
        lo = np.maximum(lo, begin)
        stop, going = hi.copy(), np.flatnonzero(lo < hi)
        while len(going):
            mid = (lo[going] + hi[going]) >> 1
            less = self._low(mid) < low[going]
            lo[going] = np.where(less, mid + 1, lo[going])
            hi[going] = np.where(less, hi[going], mid)
            going = going[lo[going] < hi[going]]
        out = np.full(len(v), -1, np.int64)
        near = np.flatnonzero(lo < stop)
        hit = near[self._low(lo[near]) == low[near]]
        out[hit] = lo[hit]
        return out
