"""Connected components of an edge table: tasks contract what they hold, least labels with pointer jumping join the rest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch_of, discard, durable

SALTS = 8
TASK_EDGES = 2_000_000  #: edges that one task contracts at once, 16 bytes each
SHRINKS = 0.7  #: contraction goes on while a round leaves at most this part of the edges


def spread_join(big: DataFrame, small: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join on key with a table that has a key once; rows of one key in `big` go to SALTS tasks by the hash of `by`."""
    salted = big.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    # The copies of a row shrink in a shuffle, so its size there would let a much larger table be broadcast.
    copies = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    return salted.join(copies, [key, "salt"]).drop("salt")


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges a[i] - b[i], ascending, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        x, y = label[x], label[y]
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def _contractor(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """An edge from each node to the least node of its component among the edges held, some `limit` at once; where contraction makes no room for more, they are let go."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            n += batch.num_rows
            if n >= limit:
                star = least_labels(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, n = [star], len(star[0])
                if n > SHRINKS * limit:
                    yield batch_of(a=star[0], b=star[1])
                    held, n = [], 0
        if held:
            a, b = least_labels(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield batch_of(a=a, b=b)

    return run


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), both long and not null -> node, comp: the least node of each node's component; a node with an edge to itself alone is a component.

    Tasks replace the edges they hold by stars, first where the edges lie, then over ever fewer tasks by the hash of the edge, so no node is a key. Stars that one task can hold are
    the result. Where that many nodes are left that rounds no longer shrink them, `label_rounds` ends the work with the same result. Each round is stored: no lineage grows, and a lost
    executor costs one round at most."""
    stars = durable(arrow_map(edges.select(F.col("a").cast("long"), F.col("b").cast("long")), _contractor(TASK_EDGES), "a long, b long"), "stars")
    n = stars.count()
    while True:
        tasks = max(1, -(-n // TASK_EDGES))
        fewer = durable(arrow_map(stars.repartition(tasks, "a", "b"), _contractor(TASK_EDGES), "a long, b long"), "stars")
        discard(stars)
        if tasks == 1:
            return fewer.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        stars, before, n = fewer, n, fewer.count()
        if n > TASK_EDGES and n > SHRINKS * before:
            found = label_rounds(stars)
            discard(stars)
            return found


def label_rounds(edges: DataFrame) -> DataFrame:
    """Components by rounds of joins. Each round takes the least label among neighbours and then that
    label's own label, so paths halve; rounds are stored. A node with many neighbours and the label of a
    large component are no single key."""
    both = durable(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), "labels")
    while True:
        seen = spread_join(both, labels.select(F.col("node").alias("b"), "comp"), "b", "a").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        lower = labels.join(seen, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        target = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        new = durable(spread_join(lower, target, "comp", "node").select("node", "old", F.least("comp", "next").alias("comp")), "labels")
        settled = new.where("old <> comp").isEmpty()
        discard(labels)
        if settled:
            discard(both)
            return new.select("node", "comp")
        labels = new
