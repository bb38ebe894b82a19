"""Vectorised word splitting over text buffers: byte classes in, one 64-bit hash for each word out."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import mix64

PLACES = 64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Value of a byte at a place within its word.
_VALUES = mix64(np.arange(1, 256 * PLACES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

#: Bytes of a word after A-Z were lower-cased: digits, a-z and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: Bytes of a word between ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False


@dataclass
class Words:
    hashes: np.ndarray  #: uint64, equal for equal words, whatever the buffer
    owner: np.ndarray  #: text of each word
    start: np.ndarray  #: bytes, in the buffer
    end: np.ndarray
    counts: np.ndarray  #: words of each text


def split(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, chunk: int = 1 << 19) -> Words:
    """Words of all texts of a buffer; A-Z count as lower case. `inside` says which bytes belong to words. About `chunk` bytes are handled at a time, as each takes
    some fifty while it is hashed; a longer text is cut after a byte that belongs to no word."""
    n = len(data)
    if n <= chunk:
        return _split(data, offsets, inside)
    parts, counts, at = [], np.zeros(len(offsets) - 1, np.int64), 0
    while at < n:
        upto = _cut(data, offsets, inside, at, min(at + chunk, n))
        first, last = int(np.searchsorted(offsets, at, side="right")) - 1, int(np.searchsorted(offsets, upto))
        w = _split(data[at:upto], np.clip(offsets[first : last + 1], at, upto) - at, inside)
        counts[first:last] += w.counts
        parts.append((w.hashes, w.owner + first, w.start + at, w.end + at))
        at = upto
    return Words(*(np.concatenate(x) for x in zip(*parts, strict=True)), counts)


def _cut(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, at: int, upto: int) -> int:
    """The last place after `at` and up to `upto` where no word goes on; the first beyond it if there is none."""
    if upto == len(data):
        return upto
    edge = int(offsets[np.searchsorted(offsets, upto, side="right") - 1])
    outside = np.flatnonzero(~inside[LOWER[data[max(at, edge) : upto]]])
    if len(outside):
        return max(at, edge) + int(outside[-1]) + 1
    if edge > at:
        return edge
    end = int(offsets[np.searchsorted(offsets, upto, side="right")])
    for i in range(upto, end, 1 << 16):
        outside = np.flatnonzero(~inside[LOWER[data[i : min(i + (1 << 16), end)]]])
        if len(outside):
            return i + int(outside[0]) + 1
    return end


def _split(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    low, n, texts = LOWER[data], len(data), len(offsets) - 1
    held = inside[low]
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    begins = held.copy()
    begins[1:] &= ~held[:-1] | fresh[1:n]
    ends = held.copy()
    ends[:-1] &= ~held[1:] | fresh[1:n]
    a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(a):
        return Words(np.empty(0, np.uint64), a, a, b, np.zeros(texts, np.int64))
    size = b - a
    where = np.flatnonzero(held)
    place = np.arange(len(where)) - np.repeat(np.cumsum(size) - size, size)
    byte = low[where].astype(np.int64)
    with np.errstate(over="ignore"):
        value = _VALUES[np.minimum(place, PLACES - 1) * 256 + byte]
        far = np.flatnonzero(place >= PLACES - 1)
        if len(far):
            value[far] = mix64((place[far].astype(np.uint64) << np.uint64(9)) + byte[far].astype(np.uint64) + np.uint64(1 << 40))
        hashes = mix64(np.add.reduceat(value, np.cumsum(size) - size) + size.astype(np.uint64))
    owner = np.searchsorted(offsets, a, side="right") - 1
    return Words(hashes, owner, a, b, np.bincount(owner, minlength=texts))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each run of k words; a text of fewer words, but not none, gives one run of all its words."""
    h, m = words.hashes, len(words.hashes)
    with np.errstate(over="ignore"):
        mult = [mix64(np.array([j + 1], np.uint64))[0] | np.uint64(1) for j in range(k)]
        runs = np.zeros(max(m - k + 1, 0), np.uint64)
        for j in range(k):
            runs += h[j : j + len(runs)] * mult[j]
        whole = words.owner[: len(runs)] == words.owner[k - 1 :] if m >= k else np.zeros(0, bool)
        found, owner = mix64(runs[whole] + np.uint64(k)), words.owner[: len(runs)][whole]
        few = np.flatnonzero((words.counts > 0) & (words.counts < k))
        if len(few):
            heads = np.searchsorted(words.owner, few)
            short = np.array([np.sum(h[a : a + c] * np.array(mult[:c], np.uint64), dtype=np.uint64) + np.uint64(c) for a, c in zip(heads.tolist(), words.counts[few].tolist(), strict=True)], np.uint64)
            found, owner = np.concatenate([found, mix64(short)]), np.concatenate([owner, few])
    return found, owner
