"""Digests of all words of an Arrow column of texts, by array operations on its bytes.

A word's digest is the sum of T[byte] * M^place over its bytes modulo 2^64, for a fixed
random table T, then mixed. Letters A-Z count as a-z, the six separators as zero. Texts are
taken in pieces of about PIECE bytes, cut at separators, so memory does not grow with a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
PIECE = 1 << 21
SEPARATORS = b" \t\n\v\f\r"
_M = int.from_bytes(b"odd mult", "little") | 1
_draw = np.random.Generator(np.random.PCG64(42))
TABLE = _draw.integers(1, 1 << 63, 256, np.uint64)
TABLE[65:91] = TABLE[97:123]
TABLE[list(SEPARATORS)] = 0
_ALNUM = np.array([chr(k).isascii() and chr(k).isalnum() for k in range(256)])
GAP = np.isin(np.arange(256), list(SEPARATORS))


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(n - 1, base & (1 << 64) - 1, U)]))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> U(32)) * U(0xD6E8FEB86659FD93)
    h = (h ^ h >> U(32)) * U(0xD6E8FEB86659FD93)
    return h ^ h >> U(32)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    if column.null_count:
        column = column.fill_null(pa.scalar("").cast(column.type))
    wide = column.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    at = np.frombuffer(offsets, np.int64)[wide.offset:wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), at


class Hasher:
    """plain: words end at separators; else every ASCII byte that is no letter or digit ends them too."""

    def __init__(self, plain: bool = True):
        self.gap = GAP if plain else ~(_ALNUM | (np.arange(256) > 127))
        self.table = np.where(self.gap, U(0), TABLE)
        self.up, self.down = _powers(_M, PIECE), _powers(pow(_M, -1, 1 << 64), PIECE)

    def _piece(self, data: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(digests, starts) of the words; fresh: places where a text begins."""
        if len(data) > len(self.up):
            self.up, self.down = _powers(_M, len(data)), _powers(pow(_M, -1, 1 << 64), len(data))
        letter = ~self.gap[data]
        begins = letter.copy()
        begins[1:] &= ~letter[:-1]
        begins[fresh] = letter[fresh]
        start = np.flatnonzero(begins)
        if not len(start):
            return np.empty(0, U), start
        part = self.table[data] * self.up[: len(data)]
        return mix(np.add.reduceat(part, start) * self.down[start]), start

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(digests of all words in order, number of words of each text)."""
        cuts = cut_places(data, offsets)
        found, size = [], np.zeros(len(offsets) - 1, np.int64)
        for s, e in zip(cuts, cuts[1:]):
            inner = offsets[np.searchsorted(offsets, s):np.searchsorted(offsets, e)]
            h, start = self._piece(data[s:e], inner - s)
            found.append(h)
            size += np.bincount(np.searchsorted(offsets, start + s, "right") - 1, minlength=len(size)) if len(start) else 0
        return np.concatenate(found) if found else np.empty(0, U), size


def cut_places(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Borders of pieces of about PIECE bytes that cut no word."""
    at, last = int(offsets[0]), int(offsets[-1])
    out = [at]
    while at < last:
        goal = min(at + PIECE, last)
        if goal < last:
            back = int(offsets[np.searchsorted(offsets, goal, "right") - 1])
            if back > at:
                goal = back
            else:
                step = np.flatnonzero(GAP[data[at:goal]])
                while not len(step) and goal < last:  # one word longer than a piece
                    goal = min(goal + PIECE, last)
                    step = np.flatnonzero(GAP[data[at:goal]])
                after = int(offsets[np.searchsorted(offsets, at, "right")])
                goal = min(at + int(step[-1]) + 1 if len(step) else goal, after)
        out.append(goal)
        at = goal
    return out


def groups(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of at most limit bytes; a longer text is a range of its own."""
    k, n = 0, len(offsets) - 1
    while k < n:
        stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + limit, "right")) - 1)
        yield k, min(stop, n)
        k = min(stop, n)
