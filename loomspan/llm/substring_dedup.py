"""Operator 5: removal of repeated strings by hash-compared suffix sorting.

Every byte covered by a string of 400 bytes that also starts anywhere else goes. Beside that, words covered by a run of 50 words that
also starts anywhere else are counted: a passage of over 50 words may be shorter than 400 bytes. Both are one algorithm over letters (bytes, or
64-bit hashes of words); a window is a string of `length` letters. All windows count, but only few positions travel:

1. Each window is represented by its anchor: of the `gram`-letter strings inside it the one with the least hash, the last such.
   Equal windows have equal anchors at the same place, so windows are grouped by anchor.
2. Anchors meet by the hash of their gram, packed some thousand to a row. An anchor whose gram is nowhere else is done. One whose
   whole stretch (all windows of that anchor) is elsewhere too is repeated throughout. A task settles what repeats within it and sends each stretch once,
   so a passage that a third of all texts hold is one entry for each task. What is left are anchors near the ends of repeated passages.
3. Their surroundings are gathered in bounded deals and suffix-sorted from the anchor on, comparing by prefix hashes and binary
   search; neighbours that agree over a gram, checked letter by letter, form the groups. Within a group, ranges of window starts are
   bisected: suffixes that agree on all letters of a range's windows are repeated there (again checked letter by letter), those that agree with no other on the
   letters that all its windows share are done, and the rest is bisected further.
4. The surroundings of an anchor string that has more than `hot` of them are split by window, as they cannot all meet in one task: a task
   compares the windows it has letter by letter and sends any one once.

Collision verification: what the suffix sort and the bisection of step 3 find equal, and windows that one task has in step 4, are compared letter by letter. Whole stretches (step 2, in one task too) and
windows in different tasks are equal if 128-bit BLAKE2b digests of their letters are, whole texts if 128 bits of SHA-256 are. Letters of the word unit are 64-bit hashes of words, so
n_passage_words rests on these. No result of the byte unit rests on a prefix hash.

Defined results: null and empty texts have 0 bytes and nothing removed. Copies of a text of 400 bytes or more are removed whole; shorter texts are kept.
Ties between equal grams go to the last. Very long texts are handled in overlapping parts, so memory does not follow their length. An empty table gives
an empty table. Rows repeat as they do in docs, and repeated rows are copies of each other; doc_id may be null; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch_of, durable, mix64, ranges, slices, text_buffer
from .suffix_sort import PrefixHash, common_extension, same_letters, suffix_sort
from .wordhash import NOT_SPACE, split

BUCKET_ANCHORS = 1_000_000  #: anchors that one task sorts
FLUSH = 1_000_000  #: anchors that a task holds before it sends them
DEAL = 2_000  #: surroundings in one task, about
HOT = 2_000  #: surroundings of one anchor string beyond which they are split by window
SLICE = 1 << 20

_PLACE = np.uint64((1 << 28) - 1)
_KEY = pa.binary(16)


@dataclass(frozen=True)
class Unit:
    """What texts are strings of: bytes, or words between white space, A-Z in lower case."""

    length: int
    gram: int
    words: bool = False

    def letters(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Letters of all texts, one after another, and the n + 1 offsets."""
        if not self.words:
            return text_buffer(column)
        w = split(*text_buffer(column), NOT_SPACE)
        return w.hashes, np.concatenate([[0], np.cumsum(w.counts)])


BYTES = Unit(400, 200)
PASSAGES = Unit(50, 12, words=True)


def parts_of(letters: np.ndarray, offsets: np.ndarray, length: int, size: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The texts (their numbers, 0 as the place of each part, letters, offsets), or if that is much, overlapping parts of each: a window is in one part."""
    n = len(offsets) - 1
    if len(letters) <= 2 * size:
        yield np.arange(n), np.zeros(n, np.int64), letters, offsets
        return
    for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for at in range(lo, hi - length + 1, size):
            part = letters[at : min(at + size + length - 1, hi)]
            yield np.array([i]), np.array([at - lo]), part, np.array([0, len(part)])


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[PrefixHash, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prefix hashes of the buffer, and for each anchor its text, its position, and the first and last window start that it stands for (all in the buffer)."""
    h = PrefixHash(data)
    wide = length - gram + 1
    starts = ranges(offsets[:-1], np.maximum(np.diff(offsets) - length + 1, 0))
    none = np.empty(0, np.int64)
    if not len(starts):
        return h, none, none, none, none
    at = np.arange(len(data) - gram + 1)
    key = (mix64(h.of(at, at + gram)) & ~_PLACE) | (_PLACE - at.astype(np.uint64))
    size = 1
    while size * 2 <= wide:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    n = len(key) - (wide - size)
    least = np.minimum(key[:n], key[wide - size :])
    anchor = (_PLACE - (least[starts] & _PLACE)).astype(np.int64)
    text = np.searchsorted(offsets, starts, side="right") - 1
    head = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])))
    last = np.append(head[1:], len(starts)) - 1
    return h, text[head], anchor[head], starts[head], starts[last]


def gram_hash(h: PrefixHash, a: np.ndarray, gram: int) -> np.ndarray:
    return mix64(h.of(a, a + gram) + np.uint64(1))


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit digests of data[start:end], as rows of two numbers."""
    raw, item = memoryview(np.ascontiguousarray(data)).cast("B"), data.itemsize
    found = b"".join([hashlib.blake2b(raw[i:j], digest_size=16).digest() for i, j in zip((start * item).tolist(), (end * item).tolist(), strict=True)])
    return np.frombuffer(found, "<u8").reshape(-1, 2).copy()


def _numbers(column: pa.Array | pa.ChunkedArray | list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column if isinstance(column, list) else column.to_pylist()), kind)


def _change(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before it; the first does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _cells(x: np.ndarray, head: np.ndarray, tail: np.ndarray) -> pa.Array:
    return pa.array([x[i:j].tobytes() for i, j in zip(head.tolist(), tail.tolist(), strict=True)], pa.binary())


def _tails(head: np.ndarray, n: int) -> np.ndarray:
    return np.append(head[1:], n) if len(head) else head


ANCHORS = "bucket int, grams binary, stretches binary, many binary, pos binary, lo binary, hi binary, keys binary, counts binary"


def _packed(bucket: np.ndarray, keys: np.ndarray, text: np.ndarray, g: np.ndarray, d: np.ndarray, many: np.ndarray, pos: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket: its anchors by text, the keys of its texts and how many anchors each has."""
    order = np.lexsort((text, bucket))
    bucket, text, g, d, many, pos, lo, hi = (x[order] for x in (bucket, text, g, d, many, pos, lo, hi))
    a = np.flatnonzero(_change(bucket))
    head = np.flatnonzero(_change(bucket, text))
    b, z = _tails(a, len(bucket)), np.append(np.searchsorted(head, a), len(head))
    runs, own = np.diff(np.append(head, len(bucket))).astype("<u4"), keys[text[head]]
    return batch_of(bucket=pa.array(bucket[a], pa.int32()), grams=_cells(g, a, b), stretches=_cells(d, a, b), many=_cells(many.astype("u1"), a, b), pos=_cells(pos.astype("<u4"), a, b), lo=_cells(lo.astype("<u2"), a, b), hi=_cells(hi.astype("<u2"), a, b), keys=_cells(own, z[:-1], z[1:]), counts=_cells(runs, z[:-1], z[1:]))


def _anchor_rows(units: tuple[Unit, ...], buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Anchors of all units, dealt to `buckets` buckets for each. What repeats within the task goes to a negative bucket, settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        seen: set[bytes] = set()
        held: list[list[tuple[np.ndarray, ...]]] = [[] for _ in units]
        keys: list[bytes] = []

        def send() -> Iterator[pa.RecordBatch]:
            own = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
            for u in range(len(units)):
                if not held[u]:
                    continue
                g, d, pos, lo, hi, text = (np.concatenate(x) for x in zip(*held[u], strict=True))
                held[u].clear()
                order = np.lexsort((pos, text, d[:, 1], d[:, 0], g))
                g, d, pos, lo, hi, text = (x[order] for x in (g, d, pos, lo, hi, text))
                first = _change(g, d[:, 0], d[:, 1])
                head = np.flatnonzero(first)
                n = np.diff(np.append(head, len(g)))
                many = np.repeat(n > 1, n)
                if many.any():
                    k = int(many.sum())
                    yield _packed(np.full(k, -1 - (task % buckets * len(units) + u)), own, text[many], np.zeros(k, np.uint64), np.zeros((k, 2), np.uint64), many[many], pos[many], lo[many], hi[many])
                bucket = ((g[head] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64) * len(units) + u
                yield _packed(bucket, own, *(x[head] for x in (text, g, d, many, pos, lo, hi)))
            keys.clear()

        for batch in slices(batches, limit=SLICE):
            names = batch.column("key").to_pylist()
            fresh = [k not in seen and not seen.add(k) for k in names]
            if not all(fresh):
                batch, names = batch.filter(pa.array(fresh)), [k for k, f in zip(names, fresh, strict=True) if f]
            for u, unit in enumerate(units):
                for index, base, data, offsets in parts_of(*unit.letters(batch.column("text")), unit.length):
                    h, text, a, first, last = anchors_of(data, offsets, unit.length, unit.gram)
                    if len(a):
                        d = digests(data, first, last + unit.length)
                        d[:, 0] ^= mix64((a - first) << 16 | (last - first))
                        held[u].append((gram_hash(h, a, unit.gram), d, a - offsets[text] + base[text], a - last, a - first, len(keys) + index[text]))
            keys += names
            if sum(len(x[0]) for own in held for x in own) > FLUSH:
                yield from send()
        yield from send()

    return run


FOUND = "key binary, unit int, pos binary, start binary, end binary, send binary, hot binary, sends boolean"


def _found(key: np.ndarray, u: int, pos: np.ndarray, start: np.ndarray, end: np.ndarray, send: np.ndarray, hot: np.ndarray) -> pa.Table:
    """One row for each text."""
    order = np.lexsort((key[:, 1], key[:, 0]))
    key, pos, start, end, send, hot = (x[order] for x in (key, pos, start, end, send, hot))
    a = np.flatnonzero(_change(key[:, 0], key[:, 1]))
    b = _tails(a, len(key))
    return pa.table({"key": _cells(key, a, a + 1), "unit": pa.array(np.full(len(a), u), pa.int32()), "pos": _cells(pos.astype("<u4"), a, b), "start": _cells(start.astype("<u4"), a, b), "end": _cells(end.astype("<u4"), a, b), "send": _cells(send.astype("u1"), a, b), "hot": _cells(hot.astype("u1"), a, b), "sends": pa.array(np.add.reduceat(send.astype(int), a) > 0 if len(a) else [], pa.bool_())})


def _sort_out(units: tuple[Unit, ...], hot: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        """What a bucket shows: repeated stretches as spans, and anchors whose surroundings are needed (send)."""
        bucket = table["bucket"][0].as_py()
        u = bucket % len(units) if bucket >= 0 else (-1 - bucket) % len(units)
        length = units[u].length
        pos, lo, hi = _numbers(table["pos"], "<u4"), _numbers(table["lo"], "<u2"), _numbers(table["hi"], "<u2")
        key = np.repeat(_numbers(table["keys"], "<u8").reshape(-1, 2), _numbers(table["counts"], "<u4"), axis=0)
        if bucket < 0:
            nothing = np.zeros(len(pos), bool)
            return _found(key, u, pos, pos - hi.astype("<u4"), pos - lo.astype("<u4") + np.uint32(length), nothing, nothing)
        g, d, many = _numbers(table["grams"], "<u8"), _numbers(table["stretches"], "<u8").reshape(-1, 2), _numbers(table["many"], "u1") > 0
        order = np.lexsort((~many, pos, key[:, 1], key[:, 0], d[:, 1], d[:, 0], g))
        g, d, many, pos, lo, hi, key = (x[order] for x in (g, d, many, pos, lo, hi, key))
        new = _change(g, d[:, 0], d[:, 1], key[:, 0], key[:, 1], pos)  # a text may come from several tasks
        g, d, many, pos, lo, hi, key = (x[new] for x in (g, d, many, pos, lo, hi, key))

        first = _change(g, d[:, 0], d[:, 1])
        kind, group = np.cumsum(first) - 1, np.cumsum(_change(g)) - 1
        whole = (np.bincount(kind, 1 + many)[kind] if len(g) else np.empty(0)) > 1
        send = first & (np.bincount(group, first)[group] > 1) & (np.bincount(group, ~whole)[group] > 0) if len(g) else first
        load = np.bincount(group, send)[group] if len(g) else np.empty(0)
        keep = whole | send
        key, pos, lo, hi, whole, send, load = (x[keep] for x in (key, pos, lo, hi, whole, send, load))
        start, end = np.where(whole, pos - hi.astype("<u4"), 0), np.where(whole, pos - lo.astype("<u4") + np.uint32(length), 0)
        return _found(key, u, pos, start, end, send, load > hot)

    return run


#: kind 0: surroundings (gram, key, pos, at, data); kind 1: windows of hot anchors (bucket in gram; digests and references packed); kind 2: spans that a task settled itself.
AROUND = "kind int, unit int, gram long, key binary, pos long, at int, data binary, refs binary, places binary"


def _once(hashes: np.ndarray, data: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows at `start` one of each kind, and whether each has a twin. Those of equal hash are compared with the first of them; one that differs stays a kind of its own."""
    order = np.argsort(hashes, kind="stable")
    first = _change(hashes[order])
    head = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))] if len(order) else order
    same = np.ones(len(order), bool)
    rest = np.flatnonzero(~first)
    same[rest] = same_letters(data, start[order[rest]], start[head[rest]], length)
    twin = np.zeros(len(order), bool)
    joined = rest[same[rest]]
    twin[order[joined]] = True
    twin[head[joined]] = True
    return order[first | ~same], twin


def _around_rows(units: tuple[Unit, ...], buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            key = _numbers(batch.column("key"), "<u8").reshape(-1, 2)
            asked = batch.column("asked").to_pylist()
            for u, unit in enumerate(units):
                own, warm = [], []
                for t, rows in enumerate(asked):
                    for r in rows:
                        if r["unit"] == u:
                            pos, send, hot = np.frombuffer(r["pos"], "<u4").astype(np.int64), np.frombuffer(r["send"], "u1") > 0, np.frombuffer(r["hot"], "u1") > 0
                            for into, mask in ((own, send & ~hot), (warm, send & hot)):
                                if mask.any():
                                    into.append((t, np.unique(pos[mask])))
                if own or warm:
                    letters, offsets = unit.letters(batch.column("text"))
                    if own:
                        yield _surroundings(unit, u, key, letters, offsets, own)
                    if warm:
                        yield from _windows(unit, u, key, letters, offsets, warm, buckets)

    return run


def _places(own: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.full(len(p), t) for t, p in own]), np.concatenate([p for _, p in own])


def _surroundings(unit: Unit, u: int, key: np.ndarray, letters: np.ndarray, offsets: np.ndarray, own: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    text, pos = _places(own)
    a = offsets[text] + pos
    lo, hi = np.maximum(a - (unit.length - unit.gram), offsets[text]), np.minimum(a + unit.length, offsets[text + 1])
    pieces = [letters[i:j] for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]
    data, begin = np.concatenate(pieces), np.cumsum(hi - lo) - (hi - lo)
    n, g = len(a), gram_hash(PrefixHash(data), begin + a - lo, unit.gram)
    nulls = pa.nulls(n, pa.binary())
    return batch_of(kind=pa.array(np.zeros(n), pa.int32()), unit=pa.array(np.full(n, u), pa.int32()), gram=pa.array(g.astype(np.int64)), key=_cells(key[text], np.arange(n), np.arange(1, n + 1)), pos=pa.array(pos), at=pa.array(a - lo, pa.int32()), data=pa.array([p.tobytes() for p in pieces], pa.binary()), refs=nulls, places=nulls)


def _windows(unit: Unit, u: int, key: np.ndarray, letters: np.ndarray, offsets: np.ndarray, own: list[tuple[int, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """The windows of hot anchors, each kind once, and the spans of those that the task has more than once."""
    text, pos = _places(own)
    a, side = offsets[text] + pos, unit.length - unit.gram
    lo, hi = np.maximum(a - side, offsets[text]), np.minimum(a + unit.length, offsets[text + 1])
    pieces = [letters[i:j] for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]
    data, at = np.concatenate(pieces), np.cumsum(hi - lo) - (hi - lo) + a - lo
    most, least = a - lo, np.maximum(0, a + unit.length - hi)
    count = np.maximum(most - least + 1, 0)
    r, ref = ranges(least, count), np.repeat(np.arange(len(a)), count)
    start = at[ref] - r
    with np.errstate(over="ignore"):
        hashes = mix64(PrefixHash(data).of(start, start + unit.length) + r.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    once, twin = _once(hashes, data, start, unit.length)
    if twin.any():
        k = np.flatnonzero(twin)
        yield _settled(u, *_spans(key[text[ref[k]]], pos[ref[k]], r[k], unit.length))
    d = digests(data, start[once], start[once] + unit.length)
    d[:, 0] ^= mix64(r[once])
    bucket = ((d[:, 0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    head = np.flatnonzero(_change(bucket[order]))
    tail, n = _tails(head, len(order)), len(head)
    place = (pos[ref[once]] << 16 | r[once]).astype("<i8")
    yield batch_of(kind=pa.array(np.ones(n), pa.int32()), unit=pa.array(np.full(n, u), pa.int32()), gram=pa.array(bucket[order][head], pa.int64()), key=pa.nulls(n, pa.binary()), pos=pa.nulls(n, pa.int64()), at=pa.nulls(n, pa.int32()), data=_cells(d[order], head, tail), refs=_cells(key[text[ref[once]]][order], head, tail), places=_cells(place[order], head, tail))


def _spans(key: np.ndarray, pos: np.ndarray, r: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each (key, pos) the stretch from its first to its last repeated window (all hold the anchor, so they are one stretch)."""
    order = np.lexsort((r, pos, key[:, 1], key[:, 0]))
    key, pos, r = key[order], pos[order], r[order]
    head = np.flatnonzero(_change(key[:, 0], key[:, 1], pos))
    tail = _tails(head, len(pos)) - 1
    return key[head], (pos[head] - r[tail]).astype("<u4"), (pos[head] - r[head] + length).astype("<u4")


def _settled(u: int, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    n, each = len(start), np.arange(len(start))
    return batch_of(kind=pa.array(np.full(n, 2), pa.int32()), unit=pa.array(np.full(n, u), pa.int32()), gram=pa.nulls(n, pa.int64()), key=_cells(key, each, each + 1), pos=pa.nulls(n, pa.int64()), at=pa.nulls(n, pa.int32()), data=pa.nulls(n, pa.binary()), refs=_cells(start, each, each + 1), places=_cells(end, each, each + 1))


SPANS = "key binary, unit int, start binary, end binary"


def _span_table(u: int, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Table:
    each = np.arange(len(start))
    return pa.table({"key": _cells(key, each, each + 1), "unit": pa.array(np.full(len(each), u), pa.int32()), "start": _cells(start, each, each + 1), "end": _cells(end, each, each + 1)})


def _meet_hot(units: tuple[Unit, ...]) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        u = table["unit"][0].as_py()
        d, key, place = _numbers(table["data"], "<u8").reshape(-1, 2), _numbers(table["refs"], "<u8").reshape(-1, 2), _numbers(table["places"], "<i8")
        order = np.lexsort((place, key[:, 1], key[:, 0], d[:, 1], d[:, 0]))
        d, key, place = d[order], key[order], place[order]
        new = _change(d[:, 0], d[:, 1], key[:, 0], key[:, 1], place)
        d, key, place = d[new], key[new], place[new]
        head = np.flatnonzero(_change(d[:, 0], d[:, 1]))
        n = np.diff(np.append(head, len(d)))
        good = np.repeat(n > 1, n)
        return _span_table(u, *_spans(key[good], place[good] >> 16, place[good] & 0xFFFF, units[u].length))

    return run


def repeated_windows(data: np.ndarray, anchor: np.ndarray, begin: np.ndarray, end: np.ndarray, place: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For pieces data[begin:end] with an anchor each: least and greatest r such that the window from anchor - r is also in another piece at its anchor - r (greatest -1: none)."""
    n, side = len(anchor), length - gram
    h = PrefixHash(data, place)
    least, most = np.full(n, length), np.full(n, -1)
    order = suffix_sort(h, data, anchor, np.minimum(anchor + length, end))
    x, y = order[:-1], order[1:]
    agree = common_extension(h, anchor[x], anchor[y], np.minimum(np.minimum(end[x] - anchor[x], end[y] - anchor[y]), gram)) >= gram
    agree[agree] = same_letters(data, anchor[x[agree]], anchor[y[agree]], gram)
    group = np.empty(n, np.int64)
    group[order] = np.cumsum(np.append(True, ~agree)) - 1

    span = 1 << length.bit_length() - 1
    lows = np.arange(0, side + 1, span)
    item, low = np.repeat(np.arange(n), len(lows)), np.tile(lows, n)
    while len(item) and span >= 1:
        a, high = anchor[item], low + span - 1
        inner = (a - low >= begin[item]) & (a - high + length <= end[item]) & (low <= side)
        item, low, a, high = item[inner], low[inner], a[inner], high[inner]
        if not len(item):
            break
        core = mix64(h.of(a - low, a - high + length))
        outer = (a - high >= begin[item]) & (a - low + length <= end[item])
        all_ = np.where(outer, mix64(h.of(np.maximum(a - high, 0), np.minimum(a - low + length, len(data)))), item.astype(np.uint64))
        o = np.lexsort((all_, ~outer, core, low, group[item]))
        item, low, core, all_, outer, a, high = (v[o] for v in (item, low, core, all_, outer, a, high))
        change = _change(group[item], low, core)
        head = np.flatnonzero(change)
        size = np.repeat(np.diff(np.append(head, len(item))), np.diff(np.append(head, len(item))))
        fresh = change | _change(all_, outer) | ~outer
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(item)), 0))
        twin = first != np.arange(len(item))
        if twin.any():
            t = np.flatnonzero(twin)
            twin[t] = same_letters(data, (a - high)[t], (a - high)[first[t]], length + span - 1)
        settled = twin.copy()
        settled[first[twin]] = True
        np.minimum.at(least, item[settled], low[settled])
        np.maximum.at(most, item[settled], high[settled])
        # twins stop here; one of each kind goes on as a partner for others, if there are any
        on = ~twin & (size > 1)
        kinds = np.add.reduceat(~twin, head)
        on &= np.repeat(kinds, np.diff(np.append(head, len(item)))) > 1
        item, low = item[on], low[on]
        span //= 2
        if span:
            item, low = np.concatenate([item, item]), np.concatenate([low, low + span])
    return least, most


def _settle(units: tuple[Unit, ...]) -> Callable[[pa.Table], pa.Table]:
    def one(u: int, key: np.ndarray, pos: np.ndarray, at: np.ndarray, pieces: list[bytes]) -> pa.Table:
        order = np.lexsort((pos, key[:, 1], key[:, 0]))
        order = order[_change(key[order, 0], key[order, 1], pos[order])]  # a text may come from several tasks
        key, pos, at, pieces = key[order], pos[order], at[order], [pieces[i] for i in order.tolist()]
        data = np.frombuffer(b"".join(pieces), "<u8" if units[u].words else "u1")
        size = np.array([len(p) for p in pieces], np.int64) // data.itemsize
        begin = np.cumsum(size) - size
        place = np.arange(len(data), dtype=np.int32) - np.repeat(begin, size).astype(np.int32)
        least, most = repeated_windows(data, begin + at, begin, begin + size, place, units[u].length, units[u].gram)
        good = np.flatnonzero(most >= 0)
        return _span_table(u, *_spans(np.repeat(key[good], 2, axis=0), np.repeat(pos[good], 2), np.stack([least[good], most[good]], 1).reshape(-1), units[u].length))

    def run(table: pa.Table) -> pa.Table:
        unit, key, pos, at, pieces = table["unit"].to_numpy(), _numbers(table["key"], "<u8").reshape(-1, 2), table["pos"].to_numpy(), table["at"].to_numpy(), table["data"].to_pylist()
        return pa.concat_tables([one(u, key[mine], pos[mine], at[mine], [pieces[i] for i in mine.tolist()]) for u in np.unique(unit).tolist() for mine in (np.flatnonzero(unit == u),)])

    return run


def _covered(spans: list[dict], u: int, size: int) -> np.ndarray:
    """Whether each of `size` letters lies in a span."""
    a, b = (_numbers([s[x] for s in spans if s["unit"] == u], "<u4").astype(np.int64) for x in ("start", "end"))
    edge = np.bincount(a, minlength=size + 1)[: size + 1] - np.bincount(b, minlength=size + 1)[: size + 1]
    return np.cumsum(edge)[:-1] > 0


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, n_removed, n_spans, kept_sha256, n_passage_words of texts with their span lists."""
    for batch in slices(batches, limit=4 << 20):
        out: list[list] = [[], [], [], []]
        for text, spans, n_words in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "n_words")), strict=True):
            raw = np.frombuffer(text.encode(), np.uint8)
            gone = _covered(spans, 0, len(raw))
            out[0].append(int(gone.sum()))
            out[1].append(int((gone & ~np.append(False, gone[:-1])).sum()))
            out[2].append(hashlib.sha256(raw[~gone].tobytes()).hexdigest())
            out[3].append(int(_covered(spans, 1, n_words).sum()))
        yield batch_of(key=batch.column("key"), n_removed=pa.array(out[0], pa.int64()), n_spans=pa.array(out[1], pa.int64()), kept_sha256=pa.array(out[2], pa.string()), n_passage_words=pa.array(out[3], pa.int64()))


LIGHT = "doc_id long, key binary, n_bytes long, n_words long, own_sha256 string"


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=SLICE):
        data, offsets = text_buffer(batch.column("text"))
        raw = memoryview(np.ascontiguousarray(data))
        sha = [hashlib.sha256(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        held = NOT_SPACE[data]
        begins = held.copy()
        begins[1:] &= ~held[:-1]
        heads = offsets[:-1][np.diff(offsets) > 0]
        begins[heads] = held[heads]
        total = np.concatenate([[0], np.cumsum(begins)])
        yield batch_of(doc_id=batch.column("doc_id"), key=pa.array([x.digest()[:16] for x in sha], pa.binary()), n_bytes=pa.array(np.diff(offsets), pa.int64()), n_words=pa.array(np.diff(total[offsets]), pa.int64()), own_sha256=pa.array([x.hexdigest() for x in sha]))


def _first_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose key the task has not had, so that a text that a third of all rows hold is one row for each task."""
    seen: set[bytes] = set()
    for batch in batches:
        fresh = [k not in seen and not seen.add(k) for k in batch.column("key").to_pylist()]
        yield batch if all(fresh) else batch.filter(pa.array(fresh))


def remove_repeats(docs: DataFrame, of_bytes: Unit = BYTES, of_words: Unit = PASSAGES, hot: int = HOT, bucket_anchors: int = BUCKET_ANCHORS, deal: int = DEAL) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words for each row of docs (doc_id, text)."""
    units = (of_bytes, of_words)
    text = F.coalesce("text", F.lit("")).alias("text")
    light = durable(arrow_map(docs.select("doc_id", text), _facts, LIGHT), "texts")
    sums = light.agg(F.sum("n_bytes").alias("b"), F.sum("n_words").alias("w")).first()
    anchors = max((n or 0) * 2 // (unit.length - unit.gram + 2) for n, unit in zip(sums, units, strict=True))
    buckets = max(1, -(-anchors // bucket_anchors))
    least = min(of_bytes.length, 2 * of_words.length - 1)  # bytes of a text that holds a window at all
    texts = docs.select(F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32)).alias("key"), text).where(F.octet_length("text") >= least)

    found = durable(arrow_map(texts, _anchor_rows(units, buckets), ANCHORS).groupBy("bucket").applyInArrow(_sort_out(units, hot), FOUND), "anchors")
    wanted = found.where("sends").groupBy("key").agg(F.collect_list(F.struct("unit", "pos", "send", "hot")).alias("asked"))
    around = durable(arrow_map(arrow_map(texts, _first_of_task, "key binary, text string").join(wanted, "key"), _around_rows(units, buckets), AROUND), "around")
    deals = max(1, around.where("kind = 0").count() // deal)
    cold = around.where("kind = 0").select(F.pmod(F.xxhash64("unit", "gram"), F.lit(deals)).cast("int").alias("deal"), "unit", "key", "pos", "at", "data").groupBy("deal").applyInArrow(_settle(units), SPANS)
    warm = around.where("kind = 1").select("unit", "gram", "data", "refs", "places").groupBy("unit", "gram").applyInArrow(_meet_hot(units), SPANS)
    local = around.where("kind = 2").select("key", "unit", F.col("refs").alias("start"), F.col("places").alias("end"))
    spans = found.select("key", "unit", "start", "end").unionByName(cold).unionByName(warm).unionByName(local)
    copies = light.groupBy("key").agg(F.count("*").alias("copies"), F.first("n_words").alias("n_words"))
    single = spans.groupBy("key").agg(F.collect_list(F.struct("unit", "start", "end")).alias("spans")).join(copies.where("copies = 1").select("key", "n_words"), "key")
    own = arrow_map(texts, _first_of_task, "key binary, text string")  # copies of a text have no key in `single`, so they need not all travel to find that out
    cut = arrow_map(own.join(single, "key"), _cut, "key binary, n_removed long, n_spans long, kept_sha256 string, n_passage_words long")

    several = F.col("copies").isNotNull()
    gone, zero = several & (F.col("n_bytes") >= of_bytes.length), F.lit(0).cast("long")
    rows = light.join(copies.where("copies > 1").select("key", "copies"), "key", "left").join(cut, "key", "left")
    return rows.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "own_sha256")).alias("kept_sha256"),
        F.when(several & (F.col("n_words") >= of_words.length), F.col("n_words")).otherwise(F.coalesce("n_passage_words", zero)).alias("n_passage_words"),
    )


def brute_force(texts: list[str | None], length: int = BYTES.length, run: int = PASSAGES.length) -> list[tuple[int, int, int, str, int]]:
    """n_bytes, n_removed, n_spans, kept_sha256, n_passage_words by a dictionary of all windows; used by tests."""

    def covered(all_letters: list) -> list[np.ndarray]:
        seen: dict = {}
        size = length if isinstance(all_letters[0], bytes) else run
        for own in all_letters:
            for i in range(len(own) - size + 1):
                seen[own[i : i + size]] = seen.get(own[i : i + size], 0) + 1
        out = []
        for own in all_letters:
            gone = np.zeros(len(own), bool)
            for i in range(len(own) - size + 1):
                if seen[own[i : i + size]] > 1:
                    gone[i : i + size] = True
            out.append(gone)
        return out

    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    raws = [(t or "").encode() for t in texts]
    found = zip(raws, covered(raws), covered([tuple(r.translate(lower).split()) for r in raws]), strict=True) if raws else ()
    return [(len(raw), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()), hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest(), int(words.sum())) for raw, gone, words in found]
