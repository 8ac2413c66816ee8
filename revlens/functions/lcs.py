"""Longest common word subsequence of one pair of texts: the helper inside the Arrow UDFs.

Rows of the usual table are kept as bits of one integer (bit j clear: the length grows at
word j), so a row costs a few integer operations however long the other text is.
"""

from __future__ import annotations

from math import isqrt

_ROWS_IN_MEMORY = 1 << 28  # bits


def _masks(b):
    masks, bit = {}, 1
    for word in b:
        masks[word] = masks.get(word, 0) | bit
        bit <<= 1
    return masks


def _next(row, mask, full):
    hit = row & mask
    return ((row + hit) | (row & ~mask)) & full


def common_words(a, b) -> int:
    """Length of the longest common subsequence."""
    if len(a) < len(b):
        a, b = b, a
    masks, full = _masks(b), (1 << len(b)) - 1
    row = full
    for word in a:
        mask = masks.get(word)
        if mask:
            row = _next(row, mask, full)
    return len(b) - row.bit_count()


def edit_script(a, b) -> list[tuple[str, str]]:
    """Words kept, inserted and deleted, in order; equal lengths prefer the insertion last.

    Long pairs keep only every so many rows and compute the rows between them again, so
    memory stays near the square root of the table and no pair is too long.
    """
    n, m = len(a), len(b)
    masks, full = _masks(b), (1 << m) - 1
    step = n + 1 if n * m <= _ROWS_IN_MEMORY else isqrt(n) + 1
    kept = [full]
    row = full
    for i, word in enumerate(a, 1):
        row = _next(row, masks.get(word, 0), full)
        if i % step == 0:
            kept.append(row)

    block, rows = -1, []

    def length(i, j):
        nonlocal block, rows
        if i // step != block:
            block = i // step
            rows = [kept[block]]
            for word in a[block * step : min(n, block * step + step - 1)]:
                rows.append(_next(rows[-1], masks.get(word, 0), full))
        return j - (rows[i % step] & ((1 << j) - 1)).bit_count()

    ops = []
    i, j = n, m
    while i and j:
        if a[i - 1] == b[j - 1]:
            ops.append(("eq", a[i - 1]))
            i, j = i - 1, j - 1
        elif length(i, j - 1) >= length(i - 1, j):
            ops.append(("ins", b[j - 1]))
            j -= 1
        else:
            ops.append(("del", a[i - 1]))
            i -= 1
    ops.extend(("ins", word) for word in reversed(b[:j]))
    ops.extend(("del", word) for word in reversed(a[:i]))
    ops.reverse()
    return ops
