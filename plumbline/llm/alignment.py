"""Longest common subsequences of token streams.

A row of the usual table is one integer with a bit for each place of the second
stream (bit-parallel; a bit is 0 where the length grows), so a table of n by m costs
n operations on m bits. Tables beyond ``TABLE_BITS`` are cut in halves at the place
where the lengths from both ends add up to the most, so memory stays bounded.
"""

from __future__ import annotations

from collections.abc import Hashable, Sequence

import numpy as np

#: Bits of a table that is held at once.
TABLE_BITS = 1 << 28


def _rows(a: Sequence[Hashable], b: Sequence[Hashable], keep: bool) -> list[int]:
    places: dict[Hashable, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    all_ = (1 << len(b)) - 1
    row, rows = all_, []
    for x in a:
        common = row & places.get(x, 0)
        row = ((row + common) | (row - common)) & all_
        if keep:
            rows.append(row)
    return rows if keep else [row]


def _lengths(a: Sequence[Hashable], b: Sequence[Hashable]) -> np.ndarray:
    """The lengths for all of ``a`` and each beginning of ``b``."""
    row = _rows(a, b, False)[0]
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common(a: Sequence[Hashable], b: Sequence[Hashable], table_bits: int = TABLE_BITS) -> list[tuple[int, int]]:
    """Ascending pairs of places of a longest common subsequence; the same for the same streams."""
    low = 0
    while low < len(a) and low < len(b) and a[low] == b[low]:
        low += 1
    high = 0
    while high < len(a) - low and high < len(b) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    found = [(i, i) for i in range(low)]
    x, y = a[low : len(a) - high], b[low : len(b) - high]
    if x and y:
        if len(x) * len(y) <= table_bits or len(x) == 1:
            found += [(low + i, low + j) for i, j in _traced(x, y)]
        else:
            half = len(x) // 2
            cut = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
            found += [(low + i, low + j) for i, j in common(x[:half], y[:cut], table_bits)]
            found += [(low + half + i, low + cut + j) for i, j in common(x[half:], y[cut:], table_bits)]
    return found + [(len(a) - high + i, len(b) - high + i) for i in range(high)]


def _traced(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int]]:
    rows = _rows(a, b, True)
    i, j, found = len(a), len(b), []
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            found.append((i, j))
    return found[::-1]
