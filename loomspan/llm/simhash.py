"""Operator 12: SimHash near-duplicates through a Gray-order hierarchical index.

A fingerprint has 64 bits; fingerprints link at DISTANCE or fewer differing bits. All links count, only their components come out. Steps:

1. Every text's fingerprint. Equal fingerprints are one item.
2. The bits are cut into blocks of even size. Two linked items agree in all blocks but DISTANCE at least, so for each choice of the others there is a table, in which the chosen blocks
   lead the bits; items that agree in them are a group of the table. The number of blocks follows the number of items, so that groups of unlike items stay small.
3. Each table is sorted by Gray rank (the place of the bits in the reflected binary code, whose neighbours differ by one bit) and dealt to tasks by ranges of it. So a group is a
   stretch of the order, whatever its size, and no task gets a whole hot group.
4. A task builds an index over its stretch: runs of 16 items, runs of 16 of those, up to the group. A node holds the bits that all its items share, less those that its
   parent holds already. A search carries the differences so far from node to node and leaves a node where they exceed DISTANCE, or where all its items
   are already in the component of the searched item.
5. Groups longer than a part, and those that a border between tasks may have cut, are parts: each part's shared bits bound its distance from others, and the pairs of parts
   that may hold links are compared in tasks of their own.
6. What a task has joined leaves it as a forest (at most a link for each item), and the forests' components are those of all links.

Defined results: a text without words (null, empty, blank) has fingerprint zero and links like any other. A null doc_id takes part, but a component's id is its least
non-null doc_id; null if it has none. Repeated rows repeat in the result. Very long texts are taken whole. A bit set in exactly half of the hashes is 0. An empty
table gives an empty table. Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch_of, discard, durable, ranges, slices
from .components import components, spread_join

BITS = 64
DISTANCE = 4  #: differing bits up to which fingerprints link
WORDS = 4  #: words of a shingle
SEED = 42
SLICE = 1 << 20  #: bytes of text whose hashes are counted at once


@dataclass(frozen=True)
class Sizes:
    """Sizes of the search; none changes the result."""

    fan: int = 16  #: children of a node
    part: int = 8192  #: items of a group that one task compares with each other
    stretch: int = 200_000  #: entries of the sorted tables in one task, about
    meetings: int = 8  #: pairs of parts in one task
    group: int = 4096  #: unlike items in a group, for which the number of blocks is chosen
    work: int = 1 << 21  #: pairs of item and searched item that may be open at once


def fingerprint_of(text: str | None) -> list[int]:
    """Hashes of the shingles of a text, in order."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    k = min(WORDS, len(words))
    h = xxhash.xxh64_intdigest
    return [h(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints (uint64) of texts with so many hashes each, one text after another."""
    out = np.zeros(len(counts), np.uint64)
    held = np.flatnonzero(counts)
    if len(held):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, np.cumsum(counts[held]) - counts[held], axis=0, dtype=np.int64)
        out[held] = np.packbits(2 * ones > counts[held][:, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            found = [np.array(fingerprint_of(t), np.uint64) for t in batch.column("text").to_pylist()]
            counts = np.array([len(x) for x in found])
            if counts.max() > 1 << 18:  # a very long text is counted piece by piece
                fp = np.array([_long(x) for x in found], np.uint64)
            else:
                fp = majority(np.concatenate(found), counts)
            yield batch_of(doc_id=batch.column("doc_id"), fp=fp.view(np.int64))

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def _long(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


# Tables ----------------------------------------------------------------------------------------------------------------------


def blocks_for(items: int, group: int) -> int:
    """The least number of blocks with which unlike items make groups of this size at most, on average; 10 at most."""
    for n in range(DISTANCE + 1, 10):
        if items <= group << (BITS * (n - DISTANCE) // n - 1):
            return n
    return 10


def tables(blocks: int) -> list[tuple[list[tuple[int, int]], int]]:
    """For each table its blocks (lowest bit, size) from the leading one on, and the number of leading bits that the items of a group agree in."""
    edge = [BITS * i // blocks for i in range(blocks + 1)]
    cut = [(edge[i], edge[i + 1] - edge[i]) for i in range(blocks)]
    out = []
    for chosen in itertools.combinations(range(blocks), blocks - DISTANCE):
        order = [cut[i] for i in chosen] + [cut[i] for i in range(blocks) if i not in chosen]
        out.append((order, sum(cut[i][1] for i in chosen)))
    return out


def rank_of(fp: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    """Gray rank of the bits with the blocks in this order."""
    x = np.zeros(len(fp), np.uint64)
    for low, size in order:
        x = (x << np.uint64(size)) | ((fp >> np.uint64(low)) & np.uint64((1 << size) - 1))
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def bits_of(rank: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    """The fingerprint that has this rank."""
    x = rank ^ (rank >> np.uint64(1))
    fp = np.zeros(len(x), np.uint64)
    for low, size in reversed(order):
        fp |= (x & np.uint64((1 << size) - 1)) << np.uint64(low)
        x = x >> np.uint64(size)
    return fp


_TOP = np.uint64(1 << 63)  #: turned over, it makes signed numbers sort as unsigned ones


# Index -----------------------------------------------------------------------------------------------------------------------


class Index:
    """Nodes over items, given as segments (groups) of Gray order, level by level; the last level has one node for each segment."""

    def __init__(self, items: np.ndarray, cuts: np.ndarray, fan: int):
        both, any_, start, cuts = items, items, np.arange(len(items)), cuts.astype(np.int64)
        self.levels: list[tuple[np.ndarray, ...]] = []
        while not self.levels or len(start) > len(cuts) - 1:
            size = np.diff(cuts)
            runs = -(-size // fan)
            heads = np.repeat(cuts[:-1], runs) + fan * (np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs))
            both, any_ = np.bitwise_and.reduceat(both, heads), np.bitwise_or.reduceat(any_, heads)
            children = np.diff(np.append(heads, cuts[-1]))
            start = start[heads]
            cuts = np.append(0, np.cumsum(runs))
            self.levels.append((both, ~(both ^ any_), heads, children, start))
        self.items = items
        self.ends = [np.append(lv[4][1:], len(items)) for lv in self.levels]


def _union(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins what a and b name; every item keeps the least item of its component."""
    while len(a):
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def connect(index: Index, base: int, queries: np.ndarray, own: np.ndarray, segment: np.ndarray, root: np.ndarray, work: int) -> None:
    """Joins each query (an item's number `own` in root, searched in one segment) with the items behind it at DISTANCE or less. Items of the index are numbered from base on."""
    size = np.diff(np.append(index.levels[-1][4], len(index.items)))[segment]
    upto, at = np.cumsum(size), 0
    while at < len(queries):
        done = upto[at - 1] if at else 0
        to = max(int(np.searchsorted(upto, done + work, side="right")), at + 1)
        _search(index, base, queries[at:to], own[at:to], segment[at:to], root)
        at = to


def _search(index: Index, base: int, queries: np.ndarray, own: np.ndarray, segment: np.ndarray, root: np.ndarray) -> None:
    q, node = np.arange(len(queries)), segment
    far = np.zeros(len(q), np.uint8)
    seen = np.zeros(len(q), np.uint64)  # bits whose differences are counted
    held = root[base : base + len(index.items)]
    for (bits, mask, heads, children, start), end in zip(reversed(index.levels), reversed(index.ends), strict=True):
        one = np.minimum.reduceat(held, start)
        whole = one == np.maximum.reduceat(held, start)
        new = mask[node] & ~seen
        far = far + np.bitwise_count((queries[q] ^ bits[node]) & new)
        keep = (far <= DISTANCE) & (end[node] + base > own[q] + 1) & ~(whole[node] & (one[node] == root[own[q]]))
        q, node, far, seen = q[keep], node[keep], far[keep], (seen | new)[keep]
        n = children[node]
        q, far, seen, node = np.repeat(q, n), np.repeat(far, n), np.repeat(seen, n), ranges(heads[node], n)
    far = far + np.bitwise_count((queries[q] ^ index.items[node]) & ~seen)
    keep = (far <= DISTANCE) & (node + base > own[q])
    _union(root, own[q[keep]], node[keep] + base)


def forest(items: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    tied = np.flatnonzero(root != np.arange(len(root)))
    return items[tied].view(np.int64), items[root[tied]].view(np.int64)


# Tasks -----------------------------------------------------------------------------------------------------------------------

FOUND = "a long, b long, tab int, lead long, part string, both long, mask long, items binary"


def _found(a: np.ndarray, b: np.ndarray, parts: list[tuple]) -> pa.RecordBatch:
    """Links and parts in one table."""
    none, n = [None] * len(a), len(parts)
    col = lambda i, kind: pa.array(none + [p[i] for p in parts], kind)
    return batch_of(
        a=pa.array([*a.tolist(), *[None] * n], pa.int64()), b=pa.array([*b.tolist(), *[None] * n], pa.int64()), tab=col(0, pa.int32()), lead=col(1, pa.int64()), part=col(2, pa.string()), both=col(3, pa.int64()), mask=col(4, pa.int64()), items=col(5, pa.binary())
    )


def _sweep(table: pa.Table, blocks: int, sizes: Sizes) -> Iterator[pa.RecordBatch]:
    """Links within the whole groups of a stretch, and the other groups as parts."""
    tab, rank = table["tab"].to_numpy(), table["rank"].to_numpy().view(np.uint64) ^ _TOP
    plans = tables(blocks)
    for t in np.unique(tab).tolist():
        order, lead = plans[t]
        r = rank[tab == t]
        key = r >> np.uint64(BITS - lead)
        fp = bits_of(r, order)
        cuts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(r))
        size = np.diff(cuts)
        inner = (size <= sizes.part) & (np.arange(len(size)) > 0) & (np.arange(len(size)) < len(size) - 1)  # the outer groups may go on in other tasks
        took = np.repeat(inner, size)
        a = b = np.empty(0, np.int64)
        if took.any():
            own = fp[took]
            n = size[inner]
            index, root = Index(own, np.append(0, np.cumsum(n)), sizes.fan), np.arange(len(own))
            connect(index, 0, own, root.copy(), np.repeat(np.arange(len(n)), n), root, sizes.work)
            a, b = forest(own, root)
        parts = []
        for g in np.flatnonzero(~inner).tolist():
            for at in range(int(cuts[g]), int(cuts[g + 1]), sizes.part):
                x = fp[at : min(at + sizes.part, int(cuts[g + 1]))]
                both, any_ = np.bitwise_and.reduce(x), np.bitwise_or.reduce(x)
                # Parts are named by their first rank, which no other part has.
                parts.append((t, int(key[at].astype(np.int64)), f"{int(r[at]):020d}", int(both.view(np.int64)), int((~(both ^ any_)).view(np.int64)), x.tobytes()))
        yield _found(a, b, parts)


def _meet(batches: Iterator[pa.RecordBatch], sizes: Sizes) -> Iterator[pa.RecordBatch]:
    """Links of pairs of parts; a part is also compared with itself."""
    for batch in batches:
        for one, two in zip(batch.column("items").to_pylist(), batch.column("others").to_pylist(), strict=True):
            x, y = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
            if one == two:
                root = np.arange(len(x))
                connect(Index(x, np.array([0, len(x)]), sizes.fan), 0, x, root.copy(), np.zeros(len(x), np.int64), root, sizes.work)
                a, b = forest(x, root)
            else:
                root = np.arange(len(x) + len(y))
                connect(Index(y, np.array([0, len(y)]), sizes.fan), len(x), x, np.arange(len(x)), np.zeros(len(x), np.int64), root, sizes.work)
                a, b = forest(np.concatenate([x, y]), root)
            yield batch_of(a=a, b=b)


def links(items: DataFrame, count: int, sizes: Sizes = Sizes()) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b): forests of the links between distinct fingerprints (`fp`), of which there are so many; and the stored tables that they are read from."""
    blocks = blocks_for(count, sizes.group)
    plans = tables(blocks)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for t, (order, _) in enumerate(plans):
                yield batch_of(tab=pa.array(np.full(len(fp), t), pa.int32()), rank=(rank_of(fp, order) ^ _TOP).view(np.int64))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield from _sweep(pa.Table.from_batches(held), blocks, sizes)

    dealt = arrow_map(items.select("fp"), deal, "tab int, rank long")
    stretches = dealt.repartitionByRange(1 + count * len(plans) // sizes.stretch, "tab", "rank").sortWithinPartitions("tab", "rank")
    found = durable(arrow_map(stretches, sweep, FOUND), "found")
    parts = found.where("part is not null").select("tab", "lead", "part", "both", "mask", "items")
    one = parts.drop("items")
    two = one.withColumnsRenamed({"part": "part2", "both": "both2", "mask": "mask2"})
    near = durable(one.join(two, ["tab", "lead"]).where(f"part <= part2 and bit_count((both ^ both2) & mask & mask2) <= {DISTANCE}").select("tab", "part", "part2"), "near")
    slim = parts.select("tab", "part", "items")
    pairs = near.join(slim, ["tab", "part"]).join(slim.withColumnsRenamed({"part": "part2", "items": "others"}), ["tab", "part2"]).select("items", "others").repartition(1 + near.count() // sizes.meetings)
    return found.where("a is not null").select("a", "b").unionByName(arrow_map(pairs, lambda batches: _meet(batches, sizes), "a long, b long")), [found, near]


def similar(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    own = durable(fingerprints(docs), "fingerprints")
    items = durable(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "items")
    edges, stored = links(items, items.count())
    labels = components(edges)
    discard(*stored)
    known = durable(items.join(labels, items["fp"] == labels["node"], "left").select("fp", "first_id", F.coalesce("comp", "fp").alias("comp")), "known")
    first = known.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    classes = durable(spread_join(known, first, "comp", "fp").select("fp", "component_id"), "classes")
    discard(known, items)
    return spread_join(own.withColumn("row", F.monotonically_increasing_id()), classes, "fp", "row").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
