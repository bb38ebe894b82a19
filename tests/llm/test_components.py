"""Components by contraction in tasks, by rounds of joins, and by a plain walk."""

import random

import numpy as np
import pytest

from loomspan.llm import components as c


def plain(edges):
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def graphs():
    random.seed(5)
    path = [(i, i + 1) for i in range(300)]
    random.shuffle(path)
    star = [(1000, x) for x in range(1001, 1200)] + [(5000, x) for x in range(4000, 4200)]
    loose = [(random.randrange(-900, -100), random.randrange(-900, -100)) for _ in range(350)]
    return path + star + loose + [(9000, 9000), (7, 7), (2**62, -(2**62)), path[0], path[0]]


def test_least_labels():
    edges = graphs()
    nodes, comp = c.least_labels(*np.array(edges, np.int64).T)
    assert dict(zip(nodes.tolist(), comp.tolist(), strict=True)) == plain(edges)


@pytest.mark.parametrize("held", [2_000_000, 500, 40])
def test_equals_a_plain_walk(spark, monkeypatch, held):
    """One task can hold all edges; or there are more nodes than that, so rounds of joins end the work."""
    called = []
    real = c.label_rounds
    monkeypatch.setattr(c, "label_rounds", lambda edges: called.append(1) or real(edges))
    monkeypatch.setattr(c, "TASK_EDGES", held)
    edges = graphs()
    rows = c.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    assert len(rows) == len({r["node"] for r in rows})
    assert {r["node"]: r["comp"] for r in rows} == plain(edges)
    assert bool(called) == (held < 2_000_000)


def test_many_edges_of_few_nodes_stay_with_contraction(spark, monkeypatch):
    monkeypatch.setattr(c, "TASK_EDGES", 200)
    monkeypatch.setattr(c, "label_rounds", None)
    edges = spark.range(20_000).selectExpr("id % 47 as a", "(id * 31) % 47 + 1000 as b")
    rows = [(r["a"], r["b"]) for r in edges.distinct().collect()]
    assert {r["node"]: r["comp"] for r in c.components(edges).collect()} == plain(rows)


def test_no_edges(spark):
    got = c.components(spark.createDataFrame([], "a long, b long"))
    assert got.columns == ["node", "comp"] and got.count() == 0
