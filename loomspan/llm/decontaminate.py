"""Operator 4: benchmark decontamination over a distributed positional inverted index.

`build_index` stores, for each shard (the texts that a task handled at once, about SHARD_BYTES) and term,
the ascending word positions as delta-coded unsigned 32-bit values, and one directory row of the shard's
documents. `search` takes the test items in blocks of bounded size. Corpus-wide term counts order the terms of
each ten-word window; within a shard the offset-adjusted lists are intersected from the rarest term on,
which mostly ends at once. A window whose intersection over all its terms is not empty occurs there as an exact
phrase. Proximity matches are windows whose three rarest terms stand within NEAR words of where they should; a window with a term that the shard lacks has none there.

Both steps work shard by shard, so neither a frequent term nor a passage that a third of the documents
share meets in one task. Shard memory is bounded by SHARD_BYTES or one longest text.

Defined results: null and empty texts have no words and no hits. Items without words or with a null id are left out;
an item of fewer than ten words is one window. Repeated items count once for an id. Repeated documents are
separate rows, and documents or items with equal texts have equal hits. Very long texts are a shard of their own. Without items, or with an empty benchmark, nothing is hit; an empty table gives
an empty table. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch_of, durable, slices, text_buffer
from .wordhash import ALNUM, split

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
NEAR = 3
SHARD_BYTES = 3 << 20
BLOCK_BYTES = 4 << 20  #: text of test items that goes to all executors at once

_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}

INDEX = "shard long, term string, n int, postings binary, doc_ids array<long>, doc_words array<int>"


def item_words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_ASCII_LOWER))


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of docs (doc_id, text): posting rows (shard, term, n, postings) and directory rows (shard, doc_ids, doc_words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for batch in slices(batches, limit=SHARD_BYTES):
            data, offsets = text_buffer(batch.column("text"))
            w = split(data, offsets, ALNUM)
            order = np.argsort(w.hashes, kind="stable")
            h = w.hashes[order]
            head = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
            n = np.diff(np.append(head, len(h)))
            delta = order.astype(np.uint32)
            delta[1:] = np.diff(order).astype(np.uint32)
            delta[head] = order[head]
            raw, at = delta.tobytes(), (head * 4).tolist() + [len(delta) * 4]
            low = data.tobytes().lower()  # bytes.lower() changes A-Z only
            first = order[head]
            terms = [low[a:b].decode("utf-8", "replace") for a, b in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)]
            k = len(terms)
            nothing = pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.list_(pa.int32()))
            yield batch_of(shard=pa.array(np.full(k, shard)), term=pa.array(terms, pa.string()), n=pa.array(n, pa.int32()), postings=pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()), doc_ids=nothing[0], doc_words=nothing[1])
            yield batch_of(shard=pa.array([shard], pa.int64()), term=pa.nulls(1, pa.string()), n=pa.nulls(1, pa.int32()), postings=pa.nulls(1, pa.binary()), doc_ids=pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())), doc_words=pa.array([w.counts.tolist()], pa.list_(pa.int32())))
            shard += 1

    return durable(arrow_map(docs.select("doc_id", "text"), run, INDEX), "index")


def windows_of(items: list[tuple[int, str | None]]) -> dict[tuple[str, ...], list[str]]:
    """Window -> ids (as text) of the items that hold it."""
    found: dict[tuple[str, ...], set[str]] = defaultdict(set)
    for item_id, text in items:
        words = item_words(text)
        if item_id is not None and words:
            for i in range(max(len(words) - WINDOW, 0) + 1):
                found[tuple(words[i : i + WINDOW])].add(str(item_id))
    return {w: sorted(ids) for w, ids in found.items()}


def intersect(lists: list[tuple[int, np.ndarray]], slack: int = 0) -> np.ndarray:
    """Starts at which every (offset, positions) list has a position at start + offset, or within `slack` of it; lists come rarest first."""
    offset, starts = lists[0][0], lists[0][1].astype(np.int64)
    starts = starts - offset
    for offset, positions in lists[1:]:
        if not len(starts):
            break
        want = starts + offset
        k = np.searchsorted(positions, want - slack)
        inside = k < len(positions)
        starts = starts[inside & (positions[np.minimum(k, len(positions) - 1)] <= want + slack)]
    return starts


HITS = "shard long, ordinal int, doc_id long, n_words int, hits array<struct<start:int,end:int>>, items array<string>, near_items array<string>"


def _search_shard(table: pa.Table, plan: list[tuple[tuple[tuple[int, str], ...], int, list[str]]]) -> pa.RecordBatch:
    lists: dict[str, np.ndarray] = {}
    for term, raw in zip(table["term"].to_pylist(), table["postings"].to_pylist(), strict=True):
        if term is not None:
            lists[term] = np.cumsum(np.frombuffer(raw, np.uint32), dtype=np.int64)
    directory = [(a, b) for a, b in zip(table["doc_ids"].to_pylist(), table["doc_words"].to_pylist(), strict=True) if a is not None][0]
    doc_ids, doc_words = directory[0], np.array(directory[1], np.int64)
    ends = np.cumsum(doc_words)
    total = int(ends[-1]) if len(ends) else 0
    diff = np.zeros(total + 1, np.int64)
    exact: dict[int, set[str]] = defaultdict(set)
    near: dict[int, set[str]] = defaultdict(set)

    def owners(starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts whose window stays within one document, and that document."""
        starts = starts[(starts >= 0) & (starts + size <= total)]
        doc = np.searchsorted(ends, starts, side="right")
        whole = starts + size <= ends[doc]
        return starts[whole], doc[whole]

    for terms, size, ids in plan:
        own = []
        for offset, term in terms:
            positions = lists.get(term)
            if positions is None:
                break
            own.append((offset, positions))
        if len(own) == len(terms):
            starts, doc = owners(intersect(own), size)
            np.add.at(diff, starts, 1)
            np.add.at(diff, starts + size, -1)
            for d in np.unique(doc).tolist():
                exact[d].update(ids)
        if len(own) >= 3 and size == WINDOW:
            for d in np.unique(owners(intersect(own[:3], NEAR), size)[1]).tolist():
                near[d].update(ids)

    hit = np.cumsum(diff[:total]) > 0
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])) if total else np.zeros(1, np.int8)
    base = ends - doc_words
    inner = base[(base > 0) & (base < total)]
    both = inner[hit[inner] & hit[inner - 1]] if total else inner
    starts = np.sort(np.concatenate([np.flatnonzero(edge == 1), both]))
    stops = np.sort(np.concatenate([np.flatnonzero(edge == -1), both]))
    of = np.searchsorted(ends, starts, side="right")
    spans: dict[int, list[dict[str, int]]] = defaultdict(list)
    for d, a, b in zip(of.tolist(), starts.tolist(), stops.tolist(), strict=True):
        spans[d].append({"start": a - int(base[d]), "end": b - int(base[d])})
    n = len(doc_ids)
    shard = table["shard"][0].as_py()
    return batch_of(
        shard=pa.array([shard] * n, pa.int64()),
        ordinal=pa.array(range(n), pa.int32()),
        doc_id=pa.array(doc_ids, pa.int64()),
        n_words=pa.array(doc_words, pa.int32()),
        hits=pa.array([spans.get(d, []) for d in range(n)], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        items=pa.array([sorted(exact.get(d, ())) for d in range(n)], pa.list_(pa.string())),
        near_items=pa.array([sorted(near.get(d, set()) - exact.get(d, set())) for d in range(n)], pa.list_(pa.string())),
    )


def _searcher(shared: Broadcast) -> Callable[[pa.Table], pa.Table]:
    return lambda table: pa.Table.from_batches([_search_shard(table, shared.value)])


def search(index: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each indexed document: shard, ordinal, doc_id, n_words, hits (word spans that windows cover, merged), items (ids with exact matches), near_items (ids with proximity matches only)."""
    spark = index.sparkSession
    own = items.select("item_id", "text").where("item_id is not null and text is not null")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    stored: list[str] = []
    for b in range(blocks):
        part = own if blocks == 1 else own.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        windows = windows_of([(r["item_id"], r["text"]) for r in part.collect()])
        terms = sorted({t for w in windows for t in w})
        wanted = F.broadcast(spark.createDataFrame([(t,) for t in terms], "term string"))
        counts = {r["term"]: r["n"] for r in index.join(wanted, "term").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        plan = [(tuple(sorted(enumerate(w), key=lambda x: (counts[x[1]], x))), len(w), ids) for w, ids in windows.items() if all(t in counts for t in w)]
        shared = spark.sparkContext.broadcast(plan)
        useful = F.broadcast(spark.createDataFrame([(t,) for t in sorted({t for p in plan for _, t in p[0]})], "term string"))
        rows = index.join(useful, "term", "left_semi").select(*INDEX_COLUMNS).unionByName(index.where("term is null").select(*INDEX_COLUMNS))

        found = rows.groupBy("shard").applyInArrow(_searcher(shared), HITS)
        if blocks > 1:  # each block is stored, so that neither the plan nor what is broadcast grows with their number
            stored.append(durable(found, "hits").stored_at)
            shared.unpersist()
    if blocks > 1:
        found = spark.read.schema(HITS).parquet(*stored)
        merged = found.groupBy("shard", "ordinal").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_distinct(F.flatten(F.collect_list("near_items"))).alias("near_items"))
        step = "case when size(a) > 0 and x.start <= element_at(a, -1).end then concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end)))) else concat(a, array(x)) end"
        found = merged.withColumn("hits", F.expr(f"aggregate(hits, cast(array() as array<struct<start:int,end:int>>), (a, x) -> {step})")).withColumn("near_items", F.array_except("near_items", "items"))
    return found


INDEX_COLUMNS = [c.split()[0] for c in INDEX.split(", ")]


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns from search()."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]))
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(build_index(docs), items)


ORACLE = r"""
with dw as (
  select row_number() over () as rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
iw as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where item_id is not null),
win as (
  select distinct item_id, k, array_to_string(w[i : i + k - 1], ' ') as s
  from (select item_id, w, least(10, len(w)) as k, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from iw where len(w) > 0)),
win_at as (
  select rid, k, p, array_to_string(w[p : p + k - 1], ' ') as s
  from (select rid, w, k, unnest(range(1, len(w) - k + 2)) as p from dw, (select distinct k from win))),
hit as (select a.rid, a.p, a.k, w.item_id from win_at a join win w on a.s = w.s and a.k = w.k),
covered as (select rid, count(distinct q) as n from (select rid, unnest(range(p, p + k)) as q from hit) group by rid),
found as (select rid, count(*) as n, string_agg(id, ',' order by id) as ids from (select distinct rid, cast(item_id as varchar) as id from hit) group by rid)
select d.doc_id, len(d.w) as n_words, coalesce(c.n, 0) as n_hit, coalesce(f.n, 0) as n_items, sha256(coalesce(f.ids, '')) as items_sha256, coalesce(c.n, 0) > 0 as contaminated
from dw d left join covered c using (rid) left join found f using (rid)
"""


def brute_force(text: str | None, items: list[tuple[int, str | None]]) -> tuple[int, int, list[str]]:
    """n_words, n_hit and item ids of one text by direct comparison; used by tests."""
    words = item_words(text)
    hit, ids = [False] * len(words), set()
    for item_id, item in items:
        own = item_words(item)
        size = min(len(own), WINDOW)
        if item_id is None or not own:
            continue
        wanted = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)}
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in wanted:
                hit[i : i + size] = [True] * size
                ids.add(str(item_id))
    return len(words), sum(hit), sorted(ids)
