"""Suffix order of strings of bytes, or of other letters in 64 bits, by hash comparison.

Prefix polynomial hashes modulo 2^64 over random byte values give the hash of any substring in two look-ups; a
binary search over lengths finds how far two suffixes agree (their common extension), so comparing two suffixes takes
logarithmic time whatever their length. A bottom-up mergesort uses that comparison; each merge finds the rank of all elements in
their sibling run at once, so every step is a numpy operation over all elements.

Hash equality is not trusted where it decides a result: `same_letters` compares the strings themselves.
"""

from __future__ import annotations

import numpy as np

from .common import mix64

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
VALUES = mix64(np.arange(256, dtype=np.uint64) + np.uint64(0xD1B54A32D192ED03))

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, b in enumerate((BASE, INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


class PrefixHash:
    """Substring hashes of a buffer of letters; `place` is each letter's exponent (its place in its own piece), by default its index."""

    def __init__(self, data: np.ndarray, place: np.ndarray | None = None):
        n = len(data)
        up, self.down = powers((int(place.max()) if place is not None and n else n) + 2)
        self.place = place
        with np.errstate(over="ignore"):
            v = VALUES[data] if data.dtype == np.uint8 else mix64(data)
            v *= up[:n] if place is None else up[place]
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(v, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[end] - self.sums[start]) * (self.down[start] if self.place is None else self.down[self.place[np.minimum(start, len(self.place) - 1)]])


def common_extension(h: PrefixHash, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each pair of starts the length, up to `most`, over which both suffixes agree."""
    low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high + 1) >> 1
        equal = h.of(a, a + mid) == h.of(b, b + mid)
        low, high = np.where(open_ & equal, mid, low), np.where(open_ & ~equal, mid - 1, high)


def suffix_sort(h: PrefixHash, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Order of the suffixes data[start:end]; a proper prefix comes first, equal suffixes keep their order."""

    def less(x: np.ndarray, y: np.ndarray, or_equal: bool) -> np.ndarray:
        a, b, la, lb = start[x], start[y], (end - start)[x], (end - start)[y]
        agree = common_extension(h, a, b, np.minimum(la, lb))
        done_a, done_b = agree >= la, agree >= lb
        ca = data[np.minimum(a + agree, len(data) - 1)]
        cb = data[np.minimum(b + agree, len(data) - 1)]
        return np.where(done_a & done_b, or_equal, np.where(done_a, True, np.where(done_b, False, ca < cb)))

    n = len(start)
    order, width = np.arange(n), 1
    while width < n:
        at = np.arange(n)
        run = at // width
        left = run % 2 == 0
        sibling = np.where(left, (run + 1) * width, (run - 1) * width)
        low = np.minimum(sibling, n)
        high = np.minimum(low + width, n)
        base = low.copy()
        while True:
            open_ = low < high
            if not open_.any():
                break
            mid = (low + high) >> 1
            pick = np.flatnonzero(open_)
            x, y = order[mid[pick]], order[at[pick]]
            # a left element counts right ones that are less; a right element counts left ones that are less or equal
            below = np.empty(len(pick), bool)
            of_left = left[pick]
            below[of_left] = less(x[of_left], y[of_left], False)
            below[~of_left] = less(x[~of_left], y[~of_left], True)
            low[pick[below]] = mid[pick[below]] + 1
            high[pick[~below]] = mid[pick[~below]]
        place = np.where(left, at, at - width) + (low - base)
        merged = np.empty_like(order)
        merged[place] = order
        order, width = merged, width * 2
    return order


def same_letters(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: int, rows: int = 4096) -> np.ndarray:
    """Whether data[a:a + size] equals data[b:b + size], for each pair."""
    out, span = np.ones(len(a), bool), np.arange(size)
    for i in range(0, len(a), rows):
        out[i : i + rows] = (data[a[i : i + rows, None] + span] == data[b[i : i + rows, None] + span]).all(1)
    return out
