"""Operator 3: quality by positive-unlabelled learning.

A linear model minimises the non-negative unbiased risk
    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])
over trusted positives (label 1) and unlabelled web text, which is every document of the training folds. With the squared loss the risk and its
gradient are functions of the first and second moments of the features alone. So one pass adds up the moments of all documents on the executors, and the driver
minimises the exact risk from a matrix of fixed size.

The class prior is estimated from the positives and all unlabelled texts: a model fitted on half of each is asked about the other half, whose scores are counted by bins
(`prior_of`); labels 0 are not read at all.

Features describe the form of a text, not its topic: frequencies of one- to three-byte sequences of
character classes, repetition of words and lines, and length. They are sums over the whole text.

At most PER_CLASS labelled positives are used to fit (a documented bound, on labelled rows only); every row is scored.

Defined results: null and empty texts have the features of no text and get a score too. Without positives
every score is 0. Very long texts are scored whole, one at a time. Rows repeat as they do in docs, and equal texts have equal scores; in fitting every row counts as unlabelled text, and of a repeated
positive id its least text. A null doc_id is scored, but it is never in the held-out fold and is not fitted on. An empty table gives an empty table. Other columns are kept; one named quality_score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch_of, mix64, slices, text_buffer
from .linear import fold, label_sample, sigmoid

PER_CLASS = 2000
FOLDS = 3
TRIGRAM_BITS = 8
BINS = 4096  #: bins of scores for the class prior
SALTS = 64  #: tasks that add up a block of the moments, before one adds those up
BLOCKS = 8

# Character classes: lower case, upper case, digit, space, line end, byte above ASCII, then punctuation each by its own code.
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32], _CLASS[10], _CLASS[128:] = 1, 2, 3, 4, 5, 6
_PUNCT = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASS[_PUNCT] = 7 + np.arange(len(_PUNCT))
N_CLASSES = 7 + len(_PUNCT)
N_BIGRAMS = 1 << 9
N_EXTRA = 8
WIDTH = N_CLASSES + N_BIGRAMS + (1 << TRIGRAM_BITS) + N_EXTRA


def _per_text(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, values, n)


def _repeats(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text: its number of pieces and of distinct pieces."""
    total = np.bincount(owner, minlength=n)
    key = mix64(hashes ^ mix64(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    return total, np.bincount(owner[order][new], minlength=n)


def _pieces(data: np.ndarray, owner: np.ndarray, prefix: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and owner of the stretches between break bytes (and ends of texts)."""
    inside = ~breaks
    start = inside.copy()
    start[1:] &= breaks[:-1] | (owner[1:] != owner[:-1])
    end = inside.copy()
    end[:-1] &= breaks[1:] | (owner[1:] != owner[:-1])
    a, b = np.flatnonzero(start), np.flatnonzero(end) + 1
    with np.errstate(over="ignore"):
        return (prefix[b] - prefix[a]) * np.uint64(0x9E3779B97F4A7C15) ^ (b - a).astype(np.uint64), owner[a]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """float32 matrix of n texts by WIDTH."""
    n, size = len(offsets) - 1, np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    c = _CLASS[data]
    out = np.zeros((n, WIDTH), np.float32)
    out[:, :N_CLASSES] = np.bincount(owner * N_CLASSES + c, minlength=n * N_CLASSES).reshape(n, -1)
    at = N_CLASSES
    for k, width in ((2, N_BIGRAMS), (3, 1 << TRIGRAM_BITS)):
        m = len(c) - k + 1
        if m > 0:
            code = c[:m] * N_CLASSES + c[1 : m + 1]
            code = code if k == 2 else code * N_CLASSES + c[2 : m + 2]
            slot = (code * 0x9E3779B1 & 0xFFFFFFFF) * width >> 32
            own = owner[:m] == owner[k - 1 : k - 1 + m]
            out[:, at : at + width] = np.bincount((owner[:m] * width + slot)[own], minlength=n * width).reshape(n, -1)
        at += width
    out[:, :at] = np.sqrt(out[:, :at] / np.maximum(size, 1)[:, None])
    extra = out[:, at:]
    # Position weights make equal pieces at different places differ only by a power, so words are hashed by a sum of mixed byte-and-place values within the piece.
    brk = (c == 4) | (c == 5)
    last = np.maximum.accumulate(np.where(brk | (np.arange(len(c)) == offsets[owner]), np.arange(len(c)), 0)) if len(c) else np.empty(0, np.int64)
    line_brk = c == 5
    last_line = np.maximum.accumulate(np.where(line_brk | (np.arange(len(c)) == offsets[owner]), np.arange(len(c)), 0)) if len(c) else last
    with np.errstate(over="ignore"):
        byte = data.astype(np.uint64) + np.uint64(1)
        words = np.concatenate([[np.uint64(0)], np.cumsum(mix64(byte << np.uint64(32) | (np.arange(len(c)) - last + brk[last]).astype(np.uint64)), dtype=np.uint64)]) if len(c) else np.zeros(1, np.uint64)
        lines = np.concatenate([[np.uint64(0)], np.cumsum(mix64(byte << np.uint64(32) | (np.arange(len(c)) - last_line + line_brk[last_line]).astype(np.uint64)), dtype=np.uint64)]) if len(c) else np.zeros(1, np.uint64)
    if len(c):
        h, o = _pieces(data, owner, words, brk)
        total, distinct = _repeats(h, o, n)
        same = np.bincount(o[1:][(h[1:] == h[:-1]) & (o[1:] == o[:-1])], minlength=n)
        extra[:, 0] = distinct / np.maximum(total, 1)
        extra[:, 1] = same / np.maximum(total, 1)
        extra[:, 2] = np.log1p(total) / 8
        extra[:, 3] = (size / np.maximum(total, 1)).clip(0, 40) / 10
        h, o = _pieces(data, owner, lines, line_brk)
        total, distinct = _repeats(h, o, n)
        extra[:, 4] = distinct / np.maximum(total, 1)
        extra[:, 5] = np.log1p(total) / 8
    extra[:, 6] = np.log1p(size) / 10
    extra[:, 7] = size == 0
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    intercept: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(3 * (((x - self.mean) / self.scale) @ self.weights + self.intercept)).astype(np.float64)


def moments_of(x: np.ndarray) -> np.ndarray:
    """Sums of products of features, the last of which is 1: so it holds the sums and the number of rows too."""
    a = np.append(x, np.ones((len(x), 1), np.float32), axis=1)
    return (a.T @ a).astype(np.float64)


def fit(positive: np.ndarray, moments: np.ndarray, prior: float, steps: int = 600, rate: float = 0.01, l2: float = 3e-3) -> Model:
    """Adam on the non-negative risk with the squared loss (1 - margin)^2 / 4, from the rows of positives and the moments of unlabelled texts. Where the negative part falls below zero, its
    gradient is turned round, as in the published method."""
    n, width = moments[-1, -1], len(moments) - 1
    if not len(positive) or not n:
        return Model(np.zeros(width, np.float32), np.ones(width, np.float32), np.zeros(width, np.float32), 40.0 if len(positive) else -40.0, prior)
    mean = moments[-1, :-1] / n
    scale = np.sqrt(np.maximum(np.diag(moments)[:-1] / n - mean**2, 0))
    scale = np.where(scale > 1e-6, np.maximum(scale, 0.01), 1)
    to = np.zeros((width + 1, width + 1))  # raw features to standard ones
    to[:-1, :-1], to[:-1, -1], to[-1, -1] = np.diag(1 / scale), -mean / scale, 1
    unl, pos = to @ (moments / n) @ to.T, to @ (moments_of(positive.astype(np.float32)) / len(positive)) @ to.T
    mu, mp = unl[-1], pos[-1]
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        uw, pw = unl @ w, pos @ w
        neg = (1 + 2 * mu @ w + w @ uw) / 4 - prior * (1 + 2 * mp @ w + w @ pw) / 4
        up, down = prior * (pw - mp) / 2, (mu + uw) / 2 - prior * (mp + pw) / 2
        g = (up + down if neg >= 0 else -down) + l2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(mean.astype(np.float32), scale.astype(np.float32), w[:-1].astype(np.float32), float(w[-1]), prior)


def bins_of(score: np.ndarray) -> np.ndarray:
    return np.minimum((score * BINS).astype(np.int64), BINS - 1)


def prior_of(positive: np.ndarray, unlabelled: np.ndarray, chance: float = 0.1) -> float:
    """Share of positives among unlabelled texts, from the numbers of both in each bin of scores (best-bin estimation). The highest scores hold hardly anything but positives, so there the share of
    unlabelled over the share of positives at or above a score is the prior. The score is the one at which this ratio, with a bound on its error, is least. 0.5 without
    rows on either side."""
    p, u = positive.sum(), unlabelled.sum()
    if p < 2 or u < 2:
        return 0.5
    of_p, of_u = (np.cumsum(x[::-1])[::-1] / x.sum() for x in (positive, unlabelled))
    of_p, of_u = of_p[of_p > 0], of_u[of_p > 0]
    error = np.sqrt(np.log(4 / chance) / 2) * (1 / np.sqrt(u) + 1 / np.sqrt(p))
    best = np.argmin((of_u + error) / of_p)
    return float(min(0.99, max(0.01, of_u[best] / of_p[best])))


def _featurise(df: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            x = features(*text_buffer(batch.column("text")))
            yield batch_of(doc_id=batch.column("doc_id"), x=pa.array([r.tobytes() for r in x], pa.binary()))

    rows = sorted(arrow_map(df.select("doc_id", "text"), run, "doc_id long, x binary").collect())
    return np.array([np.frombuffer(r["x"], np.float32) for r in rows]).reshape(-1, WIDTH)


def _moments(docs: DataFrame) -> np.ndarray:
    """Moments of docs' texts, by `half` (0 and 1). Tasks add up their own texts; sums of tasks are added up block by block, so no task gets more than SALTS and the tasks of one salt send it."""
    side = WIDTH + 1
    rows, columns = np.triu_indices(side)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in slices(batches, limit=1 << 20):
            half = batch.column("half").to_numpy()
            x = features(*text_buffer(batch.column("text")))
            for h in np.unique(half).tolist():
                total[h] = total.get(h, 0) + moments_of(x[half == h])
        salt = TaskContext.get().partitionId() % SALTS
        for h, m in total.items():
            for b, part in enumerate(np.array_split(m[rows, columns].astype("<f4"), BLOCKS)):
                yield batch_of(half=pa.array([h], pa.int32()), block=pa.array([b], pa.int32()), salt=pa.array([salt], pa.int32()), sums=pa.array([part.tobytes()], pa.binary()))

    def add(kind: str):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, key = 0, (0, 0)
            for batch in batches:
                for r in batch.select(["half", "block", "sums"]).to_pylist():
                    total, key = total + np.frombuffer(r["sums"], kind).astype("<f8"), (r["half"], r["block"])
            yield batch_of(half=pa.array([key[0]], pa.int32()), block=pa.array([key[1]], pa.int32()), sums=pa.array([total.tobytes()], pa.binary()))

        return run

    schema = "half int, block int, sums binary"
    sums = arrow_map(docs, own, "half int, block int, salt int, sums binary").groupBy("half", "block", "salt").applyInArrow(add("<f4"), schema).groupBy("half", "block").applyInArrow(add("<f8"), schema)
    out = np.zeros((2, side, side))
    found = {(r["half"], r["block"]): np.frombuffer(r["sums"], "<f8") for r in sums.collect()}
    for h in (0, 1):
        if (h, 0) in found:
            flat = np.concatenate([found[h, b] for b in range(BLOCKS)])
            out[h][rows, columns] = flat
            out[h][columns, rows] = flat
    return out


def _bins(docs: DataFrame, model: Model) -> np.ndarray:
    """How many of docs' texts have a score in each bin."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for batch in slices(batches, limit=1 << 20):
            total += np.bincount(bins_of(shared.value.score(features(*text_buffer(batch.column("text"))))), minlength=BINS)
        held = np.flatnonzero(total)
        yield batch_of(bin=pa.array(held, pa.int32()), n=pa.array(total[held], pa.int64()))

    out = np.zeros(BINS, np.int64)
    for r in arrow_map(docs, run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        out[r["bin"]] = r["n"]
    return out


def train(docs: DataFrame, labels: DataFrame, target: str, in_training: Column, per_class: int = PER_CLASS) -> Model:
    """Fit on at most per_class trusted positives and on all documents of the training folds."""
    own = docs.select("doc_id", "text")
    trusted = label_sample(labels, target, in_training, per_class).where("label = 1").select("doc_id")
    # Of several texts of one id the least, so repeated ids send no more rows to the driver.
    positive = _featurise(own.join(F.broadcast(trusted), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")))
    if not len(positive):
        return fit(positive, np.zeros((WIDTH + 1, WIDTH + 1)), 0.5)
    free = docs.where(F.col("doc_id").isNotNull() & in_training).select(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2)).cast("int").alias("half"), "text")
    moments = _moments(free)
    asked = fit(positive[::2], moments[0], 0.5)
    prior = prior_of(np.bincount(bins_of(asked.score(positive[1::2])), minlength=BINS), _bins(free.where("half = 1"), asked))
    return fit(positive, moments.sum(0), prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs plus quality_score, a double that takes the place of a column of that name."""
    docs = docs.drop("quality_score")
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            x = features(*text_buffer(batch.column("text")))
            m = shared.value
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(m.score(x))], names=[*names, "quality_score"])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return arrow_map(docs, run, f"{schema}, quality_score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == 1, F.lit(False))
    model = train(docs, labels, "quality", ~held)
    return score(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
