"""Operator 6: toxicity by a character n-gram linear classifier with naive Bayes scaling.

Features are the distinct hashed byte n-grams (4 to 6 bytes, A-Z lower-cased) of a text. Each is scaled
by its log-count ratio between toxic and other training texts, and a logistic regression is fitted on
the scaled features, so a document's score needs one pass over its bytes and one weight table.

Training takes at most PER_CLASS labelled texts of each class (the documented bound); scoring covers
every whole text of every row.

Defined results: null and empty texts have no n-grams: their score is that of the
intercept. Without labels of both classes no text can be told apart: the score is 0 (or 1 if all
labels are 1). Very long texts are scored whole, one at a time. Rows repeat as they do in docs, and equal texts have equal scores; in training a repeated id counts once. A null doc_id is scored but
never in the held-out fold. An empty table gives an empty table. Other columns are kept; one named like the score is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch_of, discard, durable, release_memory, slices, text_buffer
from .linear import fold, label_sample, minimise, sigmoid

SIZES = (4, 5, 6)
BITS = 20
PER_CLASS = 2000
LEAST_DOCS = 3  #: training texts that must hold an n-gram
PARTS = 16  #: ranges of n-gram slots whose counts are added up apart
BLOCK = 1 << 18  #: n-grams that one step of the solver handles at once
TASKS = 16  #: tasks that the training texts are dealt to
LEAST_Z = 3.0  #: standard errors by which its log-count ratio must differ from 0
FOLDS = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def ngrams(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For each text the distinct hashed n-grams."""
    low = _LOWER[data].astype(np.uint64)
    hashed = []
    with np.errstate(over="ignore"):
        h = low
        for n in range(2, SIZES[-1] + 1):
            m = max(len(low) - n + 1, 0)
            h = h[:m] * np.uint64(0x100000001B3) + low[n - 1 : n - 1 + m]
            if n in SIZES:
                hashed.append((((h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32))
    mark = np.zeros(1 << BITS, np.int32)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own = np.concatenate([h[a : max(b - n + 1, a)] for n, h in zip(SIZES, hashed, strict=True)])
        order = np.arange(len(own), dtype=np.int32)
        mark[own] = order
        yield own[mark[own] == order]


@dataclass
class Model:
    weights: np.ndarray
    intercept: float

    def score(self, grams: np.ndarray) -> float:
        return float(sigmoid(self.weights[grams].sum(dtype=np.float64) + self.intercept))


def chosen(seen: np.ndarray, toxic: np.ndarray, n: int, positive: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that take part, from how many texts and how many toxic ones hold each, and their log-count ratios. One takes part if its ratio stands out from chance;
    the others only add noise to long texts."""
    p, q = toxic + 1.0, seen - toxic + 1.0
    ratio = np.log(p / (positive + 2.0)) - np.log(q / (n - positive + 2.0))
    used = np.flatnonzero((seen >= min(LEAST_DOCS, n)) & (np.abs(ratio) >= LEAST_Z * np.sqrt(1 / p + 1 / q)))
    return used, ratio[used]


def solve(own: list[np.ndarray], labels: np.ndarray, used: np.ndarray, ratio: np.ndarray, l2: float = 1.0) -> Model:
    """Logistic regression on texts given as places in `used`."""
    weights = np.zeros(1 << BITS, np.float32)
    if len(labels) == 0 or labels.min() == labels.max():
        return Model(weights, 40.0 if len(labels) and labels[0] == 1 else -40.0)
    col, sizes = np.concatenate(own), np.array([len(k) for k in own])
    at = np.append(0, np.cumsum(sizes))
    cuts = np.unique(np.append(np.searchsorted(at, np.arange(0, at[-1], BLOCK)), len(own)))
    blocks = [(lo, hi, col[at[lo] : at[hi]], np.repeat(np.arange(hi - lo, dtype=np.int32), sizes[lo:hi])) for lo, hi in zip(np.append(0, cuts[:-1]), cuts, strict=True) if hi > lo]
    y = labels.astype(np.float64)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        scaled, z, g = ratio * w[:-1], np.empty(len(y)), np.zeros(len(used))
        for lo, hi, places, row in blocks:
            z[lo:hi] = np.bincount(row, scaled[places], minlength=hi - lo) + w[-1]
        p = sigmoid(z)
        for lo, hi, places, row in blocks:
            g += np.bincount(places, (p - y)[lo:hi][row], minlength=len(used))
        return float(np.logaddexp(0, z).sum() - y @ z + l2 / 2 * (w[:-1] @ w[:-1])), np.append(ratio * g + l2 * w[:-1], (p - y).sum())

    w = minimise(loss, np.zeros(len(used) + 1), steps=40)
    weights[used] = ratio * w[:-1]
    return Model(weights, float(w[-1]))


def _places(used: np.ndarray) -> np.ndarray:
    slot = np.full(1 << BITS, -1, np.int32)
    slot[used] = np.arange(len(used))
    return slot


def fit(grams: list[np.ndarray], labels: np.ndarray, l2: float = 1.0) -> Model:
    """The model of texts given by their n-grams."""
    seen, toxic = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for g, label in zip(grams, labels.tolist(), strict=True):
        seen[g] += 1
        toxic[g] += label
    used, ratio = chosen(seen, toxic, len(labels), int(labels.sum()))
    return solve([k[k >= 0] for k in (_places(used)[g] for g in grams)], labels, used, ratio, l2)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of the task's texts, and of its toxic ones, hold each n-gram."""
    seen, toxic, n, positive = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32), 0, 0
    for batch in slices(batches, limit=1 << 20):
        labels = batch.column("label").to_pylist()
        for g, label in zip(ngrams(*text_buffer(batch.column("text"))), labels, strict=True):
            seen[g] += 1
            toxic[g] += label
        n, positive = n + len(labels), positive + sum(labels)
    if n:
        yield _count_rows(seen, toxic, n, positive)


COUNTS = "part int, n long, positive long, slots binary, seen binary, toxic binary"


def _count_rows(seen: np.ndarray, toxic: np.ndarray, n: int, positive: int) -> pa.RecordBatch:
    """Counts by PARTS ranges of n-gram slots, and how many texts they are of in the first."""
    held = np.flatnonzero(seen)
    ends = np.searchsorted(held, np.arange(PARTS + 1) * ((1 << BITS) // PARTS))
    cut = [held[lo:hi] for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
    first = np.arange(PARTS) == 0
    raw = {name: pa.array([x.astype("<u4").tobytes() for x in of], pa.binary()) for name, of in (("slots", cut), ("seen", [seen[c] for c in cut]), ("toxic", [toxic[c] for c in cut]))}
    return batch_of(part=pa.array(range(PARTS), pa.int32()), n=pa.array(n * first, pa.int64()), positive=pa.array(positive * first, pa.int64()), **raw)


def _add_counts(table: pa.Table) -> pa.Table:
    """The sum of the rows of one range."""
    width = (1 << BITS) // PARTS
    part = table["part"][0].as_py()
    seen, toxic = np.zeros(width, np.int64), np.zeros(width, np.int64)
    for slots, a, b in zip(*(table[c].to_pylist() for c in ("slots", "seen", "toxic")), strict=True):
        at = np.frombuffer(slots, "<u4") - np.uint32(part * width)
        seen[at] += np.frombuffer(a, "<u4")
        toxic[at] += np.frombuffer(b, "<u4")
    held = np.flatnonzero(seen)
    n, positive = (sum(table[c].to_pylist()) for c in ("n", "positive"))
    raw = [pa.array([x.astype("<u4").tobytes()], pa.binary()) for x in (held + part * width, seen[held], toxic[held])]
    return pa.table([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([positive], pa.int64()), *raw], names=[c.split()[0] for c in COUNTS.split(", ")])


def train(docs: DataFrame, labels: DataFrame, target: str, in_training: Column, per_class: int = PER_CLASS) -> Model:
    """Fit on at most 2 * per_class texts of docs that labels has; of several texts of one id the least. The texts stay on the executors: n-gram counts that executors have added up (at most
    12 MB, however many tasks), and of each text the n-grams that take part, reach the driver."""
    sample = F.broadcast(label_sample(labels, target, in_training, per_class))
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(sample, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max(F.col("label").cast("int")).alias("label"))
    texts = durable(own.repartition(TASKS, "doc_id"), "sample")
    seen, toxic, n, positive = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64), 0, 0
    for r in arrow_map(texts, _counts, COUNTS).groupBy("part").applyInArrow(_add_counts, COUNTS).collect():
        at = np.frombuffer(r["slots"], "<u4")
        seen[at] += np.frombuffer(r["seen"], "<u4")
        toxic[at] += np.frombuffer(r["toxic"], "<u4")
        n, positive = n + r["n"], positive + r["positive"]
    used, ratio = chosen(seen, toxic, n, positive)
    shared = docs.sparkSession.sparkContext.broadcast(used)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = _places(shared.value)
        for batch in slices(batches, limit=1 << 20):
            found = [k[k >= 0].astype("<i4").tobytes() for k in (slot[g] for g in ngrams(*text_buffer(batch.column("text"))))]
            yield batch_of(doc_id=batch.column("doc_id"), label=batch.column("label"), places=pa.array(found, pa.binary()))

    rows = sorted(arrow_map(texts, places, "doc_id long, label int, places binary").collect(), key=lambda r: r["doc_id"])
    discard(texts)
    model = solve([np.frombuffer(r["places"], "<i4") for r in rows], np.array([r["label"] for r in rows], np.int64), used, ratio)
    del rows
    release_memory()
    return model


def score(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """All columns of docs (doc_id, text and any others) plus the score, a double that takes the place of a column of its name."""
    docs = docs.drop(name)
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, limit=1 << 20):
            found = [m.score(g) for g in ngrams(*text_buffer(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(found, pa.float64())], names=[*names, name])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return arrow_map(docs, run, f"{schema}, `{name}` double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == 0, F.lit(False))
    model = train(docs, labels, "toxic", ~held)
    own = docs.select("doc_id", "text")
    return score(own, model).select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
