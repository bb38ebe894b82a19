"""Operator 8: exact n-gram Jaccard join through a token-group matrix.

Two texts link when their sets of k-word shingles have similarity num / den or more. All links are found, up to
equality of 64-bit hashes; copies of one set are one node. Steps:

1. Every text's set and its signature. Equal sets share a node.
2. Exact elimination. Of each set the least-hash share PREFIX is posted by token. Linked sets of size n must share
   at least (num / den + PREFIX - 1) * n of these, so nodes with fewer shared ones have no partner. Postings travel
   packed, some thousand to a row, in hash buckets of bounded size; only counts come back.
3. Among the surviving nodes tokens are ordered by frequency, rarest first, and a set of size n keeps
   its first n - ceil(num / den * n) + 1 tokens as index tokens. Linked sets share an index token.
4. The nodes are partitioned into groups of similar ones: those whose index tokens are mostly led by the same node, cut to GROUP
   members. Each group is compared in itself, and with the first part of its own kind, which gives components.
5. The token-group matrix holds which group has which index token. Groups that share one meet, unless all their members are one component already. There
   the union of a group's tokens bounds the overlap of a set with any of its members; only sets that can reach the threshold with some member open the group, and for these all
   overlaps are computed as a matrix product.

A task holds pairs of groups of bounded size, never all nodes of a kind. Nothing is capped.

Defined results: a text without words (null, empty, blank) is linked with nothing and is its own component. A null doc_id
takes part, but a component's id is its least non-null doc_id; null if it has none. Repeated rows repeat in the result. Very long texts are taken whole. Ties of frequency go
by the token's hash. An empty table gives an empty table. Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch_of, discard, durable, mix64, slices, text_buffer
from .components import components, spread_join
from .wordhash import NOT_SPACE, shingles, split

PREFIX = (35, 100)  #: share of each set that step 2 posts
BUCKET_TOKENS = 1_000_000  #: postings that one task sorts
GROUP = 128  #: members of a group
DEAL_TOKENS = 1_000_000  #: tokens of the pairs of groups in one task (8 MB), about
SPREAD = 500  #: groups that have a token, of those that one task pairs with all others that have it
NODES = 20_000  #: sets whose counts one task adds up
INDEXED = 500  #: sets whose index tokens one task chooses
BROADCAST_IDS = 1_000_000  #: ids (8 bytes each) up to which they are broadcast; more are joined by shuffle
SLICE = 2 << 20


def sets_of(column: pa.Array, k: int) -> list[np.ndarray]:
    """For each text its ascending distinct shingle hashes."""
    words = split(*text_buffer(column), NOT_SPACE)
    h, owner = shingles(words, k)
    if len(owner) and (owner[1:] < owner[:-1]).any():
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    cut = np.searchsorted(owner, np.arange(len(column) + 1))
    return [np.unique(h[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def signature(tokens: np.ndarray) -> int:
    """64 bits of a set, signed."""
    with np.errstate(over="ignore"):
        total = np.sum(mix64(tokens ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64) + np.uint64(len(tokens))
    return int(mix64(np.array([total]))[0].astype(np.int64))


def nodes_of(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (set size), sig (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            sets = sets_of(batch.column("text"), k)
            yield batch_of(doc_id=batch.column("doc_id"), n=pa.array([len(s) for s in sets], pa.int64()), sig=pa.array([signature(s) if len(s) else None for s in sets], pa.int64()))

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n long, sig long")


#: Stands for the sets that a task itself saw share a token.
SEVERAL = -1


def _known(sets: list[np.ndarray], sigs: list[int]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """What a task sees by itself: each set's tokens that no other of its sets has, the tokens that several have, and how many of those each set has.
    So a token that many texts share is posted once for each task. Copies of a set count once."""
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    code = np.unique(np.array(sigs, np.int64), return_inverse=True)[1]
    order = np.lexsort((code[row], flat))
    token, own = flat[order], code[row][order]
    head = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    n = np.diff(np.append(head, len(token)))
    mixed = np.repeat(np.minimum.reduceat(own, head) != np.maximum.reduceat(own, head), n)
    shared = np.zeros(len(flat), bool)
    shared[order] = mixed
    at = np.cumsum([0, *map(len, sets)])
    return [s[~shared[a:b]] for s, a, b in zip(sets, at[:-1].tolist(), at[1:].tolist(), strict=True)], np.unique(token[mixed]), np.bincount(row[shared], minlength=len(sets))


POSTINGS = "bucket int, tokens binary, sigs binary, sizes binary, counts binary"


def _pack(sets: list[np.ndarray], sigs: list[int], sizes: list[int], buckets: int) -> pa.RecordBatch:
    """Tokens of some sets, dealt to buckets: one row for each bucket with its tokens, by set."""
    held = np.array([len(s) for s in sets], np.int64)
    key = mix64(np.concatenate(sets) + np.uint64(0x632BE59BD9B4E019)) if len(sets) else np.empty(0, np.uint64)
    bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    owner, token = np.repeat(np.arange(len(sets)), held)[order], key.astype("<u8")[order]
    bucket = bucket[order]
    head = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (bucket[1:] != bucket[:-1]))) if len(owner) else np.empty(0, np.int64)
    runs = np.diff(np.append(head, len(owner))).astype("<u4")
    sig, size = np.array(sigs, "<i8")[owner[head]], np.array(sizes, "<u4")[owner[head]]
    used = np.unique(bucket)
    a, b = np.searchsorted(bucket, used), np.searchsorted(bucket, used, side="right")
    c, d = np.searchsorted(bucket[head], used), np.searchsorted(bucket[head], used, side="right")
    cells = lambda x, lo, hi: pa.array([x[i:j].tobytes() for i, j in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())
    return batch_of(bucket=pa.array(used, pa.int32()), tokens=cells(token, a, b), sigs=cells(sig, c, d), sizes=cells(size, c, d), counts=cells(runs, c, d))


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (token, sig) pairs of a bucket in that order, and each one's set size."""
    raw = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
    counts = raw("counts", "<u4")
    token, sig, size = raw("tokens", "<u8"), np.repeat(raw("sigs", "<i8"), counts), np.repeat(raw("sizes", "<u4"), counts)
    order = np.lexsort((sig, token))
    token, sig, size = token[order], sig[order], size[order]
    new = np.append(True, (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])) if len(token) else np.empty(0, bool)
    return token[new], sig[new], size[new]


def _frequency(token: np.ndarray) -> np.ndarray:
    head = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    runs = np.diff(np.append(head, len(token)))
    return np.repeat(runs, runs)


def _count_shared(deals: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        """For each set of a bucket how many of its tokens other sets have too; packed, dealt by set. A negative bucket holds such counts already."""
        if table["bucket"][0].as_py() < 0:
            sig = np.frombuffer(b"".join(table["sigs"].to_pylist()), "<i8")
            found, at = np.unique(sig, return_inverse=True)
            counts = np.zeros(len(found), np.int64)
            np.maximum.at(counts, at, np.frombuffer(b"".join(table["counts"].to_pylist()), "<u4"))  # copies say the same or more
        else:
            token, sig, _ = _unpack(table)
            own = sig[(_frequency(token) > 1) & (sig != SEVERAL)] if len(token) else sig
            found, counts = np.unique(own, return_counts=True)
        deal = (mix64(found.view(np.uint64)) % np.uint64(deals)).astype(np.int64)
        order = np.argsort(deal, kind="stable")
        used, head = np.unique(deal[order], return_index=True)
        cells = lambda x, kind: pa.array([y.tobytes() for y in np.split(x[order].astype(kind), head[1:])][: len(used)], pa.binary())
        return pa.table({"deal": pa.array(used, pa.int32()), "sigs": cells(found, "<i8"), "counts": cells(counts, "<u4")})

    return run


def _sum_shared(table: pa.Table) -> pa.Table:
    sig = np.frombuffer(b"".join(table["sigs"].to_pylist()), "<i8")
    counts = np.frombuffer(b"".join(table["counts"].to_pylist()), "<u4")
    found, at = np.unique(sig, return_inverse=True)
    return pa.table({"sig": found, "shared": pa.array(np.bincount(at, counts, len(found)).astype(np.int64))})


def _indexer(deals: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        """For each set of a bucket its tokens that other sets have too, with their frequencies."""
        token, sig, size = _unpack(table)
        df = _frequency(token) if len(token) else token
        often = df > 1
        token, sig, size, df = token[often], sig[often], size[often], df[often].astype("<u4")
        order = np.argsort(sig, kind="stable")
        token, sig, size, df = token[order], sig[order], size[order], df[order]
        head = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.empty(0, np.int64)
        ends = np.append(head[1:], len(sig)) if len(head) else head
        cells = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(head.tolist(), ends.tolist(), strict=True)], pa.binary())
        return pa.table({"deal": pa.array(mix64(sig[head].view(np.uint64)) % np.uint64(deals), pa.int32()), "sig": sig[head], "n": pa.array(size[head], pa.int64()), "tokens": cells(token), "dfs": cells(df)})

    return run


def _prefixer(num: int, den: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        """Index tokens: of n - ceil(num * n / den) + 1 places, rarest first, those that tokens of one set alone leave over."""
        parts: dict[int, list[tuple[np.ndarray, bytes]]] = {}
        sizes: dict[int, int] = {}
        for sig, n, t, d in zip(*(table[c].to_pylist() for c in ("sig", "n", "tokens", "dfs")), strict=True):
            parts.setdefault(sig, []).append((np.frombuffer(t, "<i8"), d))
            sizes[sig] = n
        out: list[list] = [[], [], []]
        for sig, own in parts.items():
            token, df, n = np.concatenate([t for t, _ in own]), np.frombuffer(b"".join(d for _, d in own), "<u4"), sizes[sig]
            take = n - -(-num * n // den) + 1 - (n - len(token))
            if take > 0:
                kept = token[np.lexsort((token, df))[:take]]
                out[0].append(kept)
                out[1].append(np.full(len(kept), sig, np.int64))
                out[2].append(np.full(len(kept), n, np.int64))
        token, sig, n = (np.concatenate(x) if x else np.empty(0, np.int64) for x in out)
        return pa.table({"token": token, "sig": sig, "n": n})

    return run


def _overlaps(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b: a product of their zero-one matrices over the tokens of both sides, some columns at a time."""
    both = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)
    out = np.zeros((len(a), len(b)), np.float32)
    cells = []
    for side in (a, b):
        flat, row = np.concatenate(side), np.repeat(np.arange(len(side)), [len(x) for x in side])
        at = np.minimum(np.searchsorted(both, flat), max(len(both) - 1, 0))
        held = both[at] == flat if len(both) else np.zeros(len(flat), bool)
        order = np.argsort(at[held], kind="stable")
        cells.append((row[held][order], at[held][order]))
    for c in range(0, len(both), width):
        m = []
        for side, (row, at) in zip((a, b), cells, strict=True):
            lo, hi = np.searchsorted(at, [c, c + width])
            x = np.zeros((len(side), min(width, len(both) - c)), np.float32)
            x[row[lo:hi], at[lo:hi] - c] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return out.astype(np.int64)


def _forest(link: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges, one for each node but the first of each component, that connect what the links between a (rows) and b (columns) connect."""
    rows, cols = np.nonzero(link.any(1))[0], np.nonzero(link.any(0))[0]
    link, a, b = link[np.ix_(rows, cols)], a[rows], b[cols]
    top = np.iinfo(np.int64).max
    of_a, of_b = a.copy(), np.full(len(b), top)
    while True:
        new_b = np.minimum(of_b, np.where(link, of_a[:, None], top).min(0, initial=top))
        new_a = np.minimum(of_a, np.where(link, new_b[None, :], top).min(1, initial=top))
        if (new_a == of_a).all() and (new_b == of_b).all():
            break
        of_a, of_b = new_a, new_b
    x, y = np.concatenate([a, b]), np.concatenate([of_a, of_b])
    return x[x != y], y[x != y]


def _opener(num: int, den: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        """Pairs of groups. The union of one group's tokens bounds the overlap of a set with any of its members; sets that cannot reach the threshold with any
        are left out, and the group stays closed if none can."""
        pairs: dict[tuple[int, int], tuple[list, list]] = {}
        for g, h, side, sig, raw in zip(*(table[x].to_pylist() for x in ("ga", "gb", "side", "sig", "tokens")), strict=True):
            pairs.setdefault((g, h), ([], []))[side].append((sig, np.frombuffer(raw, "<u8")))
        out: list[list[np.ndarray]] = [[], []]
        for (g, h), (one, two) in pairs.items():
            two = one if g == h else two
            if not one or not two:
                continue
            union, least = np.unique(np.concatenate([s for _, s in two])), min(len(s) for _, s in two)
            able = []
            for sig, own in one:
                at = np.minimum(np.searchsorted(union, own), len(union) - 1)
                if den * int((union[at] == own).sum()) >= num * max(len(own), least):
                    able.append((sig, own))
            if not able:
                continue
            common = _overlaps([s for _, s in able], [s for _, s in two])
            size = [np.array([len(s) for _, s in side]) for side in (able, two)]
            link = den * common >= num * (size[0][:, None] + size[1][None, :] - common)
            x, y = _forest(link, *(np.array([sig for sig, _ in side], np.int64) for side in (able, two)))
            out[0].append(x)
            out[1].append(y)
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in out)
        return pa.table({"a": a, "b": b})

    return run


def open_groups(pairs: DataFrame, members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """pairs (ga, gb) of groups, ga = gb for a group in itself; members (grp, sig, n); sets (sig, tokens) -> links (a, b) that connect all linked members. A task holds pairs of some DEAL_TOKENS tokens, or one pair."""
    own = members.select("grp", "sig")
    load = members.groupBy("grp").agg(F.sum("n").alias("load"))
    total = pairs.join(load.select(F.col("grp").alias("ga"), F.col("load").alias("la")), "ga").join(load.select(F.col("grp").alias("gb"), F.col("load").alias("lb")), "gb").agg(F.sum(F.col("la") + F.col("lb"))).first()[0] or 0
    rows = pairs.join(own.withColumnRenamed("grp", "ga"), "ga").select("ga", "gb", F.lit(0).alias("side"), "sig").unionByName(pairs.where("ga <> gb").join(own.withColumnRenamed("grp", "gb"), "gb").select("ga", "gb", F.lit(1).alias("side"), "sig"))
    deals = max(1, -(-total // DEAL_TOKENS))
    deal: Column = F.pmod(F.xxhash64("ga", "gb"), F.lit(deals)).cast("int").alias("deal")
    return rows.join(sets.select("sig", "tokens"), "sig").select(deal, "ga", "gb", "side", "sig", "tokens").groupBy("deal").applyInArrow(_opener(num, den), "a long, b long")


def similar(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text; other columns are ignored)."""
    rows = durable(nodes_of(docs, k), "nodes")
    nodes = rows.where("sig is not null").groupBy("sig").agg(F.max("n").alias("n"), F.min("doc_id").alias("first"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    posted, of = PREFIX
    buckets = max(1, -(-total * posted // of // BUCKET_TOKENS))
    adders = max(1, rows.count() // NODES)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            own = [s for s in sets_of(batch.column("text"), k) if len(s)]
            if own:
                sigs, sizes = [signature(s) for s in own], [len(s) for s in own]
                alone, several, counts = _known([s[: -(-len(s) * posted // of)] for s in own], sigs)
                yield _pack([*alone, several], [*sigs, SEVERAL], [*sizes, 0], buckets)
                sig, bucket = np.array(sigs, "<i8"), -1 - (mix64(np.array(sigs, np.int64).view(np.uint64)) % np.uint64(adders)).astype(np.int64)
                held = counts > 0
                for b in np.unique(bucket[held]).tolist():
                    mine = held & (bucket == b)
                    yield batch_of(bucket=pa.array([b], pa.int32()), tokens=pa.array([b""], pa.binary()), sigs=pa.array([sig[mine].tobytes()]), sizes=pa.array([b""], pa.binary()), counts=pa.array([counts[mine].astype("<u4").tobytes()]))

    counts = arrow_map(docs.select("doc_id", "text"), post, POSTINGS).groupBy("bucket").applyInArrow(_count_shared(adders), "deal int, sigs binary, counts binary")
    shared = counts.groupBy("deal").applyInArrow(_sum_shared, "sig long, shared long")
    needed = f"ceil(n * {num * of + posted * den - of * den} / {of * den})" if num * of + posted * den > of * den else "1"
    left = durable(shared.join(nodes, "sig").where(f"shared >= {needed}").select("sig", "n", "first"), "left")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            own = [s for s in sets_of(batch.column("text"), k) if len(s)]
            yield batch_of(sig=pa.array([signature(s) for s in own], pa.int64()), tokens=pa.array([s.tobytes() for s in own], pa.binary()))

    n_left = left.count()
    ids = left.select(F.col("first").alias("doc_id")).distinct()
    ids = F.broadcast(ids) if n_left <= BROADCAST_IDS else ids
    kept = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").unionByName(docs.select("doc_id", "text").where("doc_id is null"))
    sets = durable(arrow_map(kept, take, "sig long, tokens binary").join(left.select("sig", "n"), "sig").dropDuplicates(["sig"]), "sets")

    tokens = left.agg(F.sum("n")).first()[0] or 0
    groups, deals = max(1, -(-tokens // BUCKET_TOKENS)), max(1, -(-n_left // INDEXED))

    def post_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "tokens", 8 << 20):
            own = [np.frombuffer(x, "<u8") for x in batch.column("tokens").to_pylist()]
            yield _pack(own, batch.column("sig").to_pylist(), [len(s) for s in own], groups)

    often = arrow_map(sets, post_all, POSTINGS).groupBy("bucket").applyInArrow(_indexer(deals), "deal int, sig long, n long, tokens binary, dfs binary")
    index = durable(often.groupBy("deal").applyInArrow(_prefixer(num, den), "token long, sig long, n long"), "index")

    leader = index.groupBy("token").agg(F.min("sig").alias("grp"), F.count("*").alias("held")).where("held > 1").select("token", "grp")
    votes = index.join(leader, "token").where("sig <> grp").groupBy("sig", "grp").agg(F.count("*").alias("votes"))
    asked = votes.groupBy("sig").agg(F.max_by("grp", F.struct("votes", "grp")).alias("grp"))

    owned = index.select("sig", "n").distinct().join(asked, "sig", "left").select("sig", "n", F.coalesce("grp", "sig").alias("lead"))
    load = owned.groupBy("lead").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    named = lambda part: F.xxhash64("lead", part)
    member = durable(owned.join(load, "lead").select("sig", "n", named(F.pmod(F.xxhash64("sig"), "parts")).alias("grp"), named(F.lit(0).cast("long")).alias("center")), "groups")
    held = member.groupBy("grp").agg(F.count("*").alias("held"), F.first("center").alias("center"))
    near = held.where("held > 1").select(F.col("grp").alias("ga"), F.col("grp").alias("gb")).unionByName(held.where("grp <> center").select(F.col("center").alias("ga"), F.col("grp").alias("gb")))
    near = durable(near, "pairs")
    first = durable(open_groups(near, member, sets, num, den), "links")

    one = components(first)
    state = member.join(one.withColumnRenamed("node", "sig"), "sig", "left").groupBy("grp").agg(*[f(F.coalesce("comp", "sig")).alias(x) for f, x in ((F.min, "c0"), (F.max, "c1"))], F.min("n").alias("low"), F.max("n").alias("high"))
    matrix = durable(index.join(member.select("sig", "grp"), "sig").select("token", "grp").distinct().join(state, "grp"), "matrix")
    # A token that many groups have is split: each of SPREAD of them meets all the others in a task of its own.
    parts = matrix.groupBy("token").agg(F.count("*").alias("held")).where("held > 1").select("token", F.expr(f"cast((held - 1) div {SPREAD} as int)").alias("last"))
    split_ = matrix.join(parts, "token")
    dealt = {"x": F.explode(F.sequence(F.lit(0), F.col("last"))), "y": F.pmod(F.xxhash64("grp"), F.col("last") + 1).cast("int")}
    side = lambda p: split_.select("token", dealt[p].alias("part"), *[F.col(c).alias(p + c) for c in ("grp", "c0", "c1", "low", "high")])
    open_ = f"xgrp < ygrp and not (xc0 = xc1 and yc0 = yc1 and xc0 = yc0) and {den} * xhigh >= {num} * ylow and {den} * yhigh >= {num} * xlow"
    far = durable(side("x").join(side("y"), ["token", "part"]).where(open_).select(F.col("xgrp").alias("ga"), F.col("ygrp").alias("gb")).distinct(), "pairs")
    more = open_groups(far, member, sets, num, den)
    links = durable(first.unionByName(more), "links")
    comps = components(links)
    discard(left, sets, index, member, near, first, matrix, far, links)

    linked = nodes.join(comps.withColumnRenamed("node", "sig"), "sig").select("sig", "first", "comp")
    least = linked.groupBy("comp").agg(F.min("first").alias("component_id"))
    found = nodes.select("sig", "first").join(spread_join(linked.select("sig", "comp"), least, "comp", "sig").select("sig", "component_id"), "sig", "left")
    joined = rows.join(found.select("sig", F.coalesce("component_id", "first").alias("component_id")), "sig", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


#: The registered query in SQL, for small tables: all pairs that share a shingle, and a recursive walk over the links.
ORACLE = r"""
with recursive d as (
  select doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] as w
  from documents),
s as (
  select distinct doc_id, g from (select doc_id, unnest(
    case when len(w) >= 4 then [array_to_string(w[i : i + 3], ' ') for i in range(1, len(w) - 2)] when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 85 * (nx.n + ny.n - c)),
r as (select doc_id, doc_id as c from d union select r.doc_id, l.y from r join l on l.x = r.c)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.c as component_id
from d left join n using (doc_id) join (select doc_id, min(c) as c from r group by doc_id) m using (doc_id)
"""
