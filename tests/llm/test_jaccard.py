import random
import re
from collections import Counter, defaultdict

import pytest
from helpers import frame, odd_rows
from oracle import compare

from loomspan.llm import jaccard_join as j
from loomspan.llm import queries
from loomspan.llm.components import components


def brute_force(rows, k, num, den=100):
    sets, seen, parent = [], {}, list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, (_, text) in enumerate(rows):
        w = [a for a in re.split("[\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if a]
        s = frozenset(tuple(w[a : a + k]) for a in range(max(len(w) - k, 0) + 1)) if w else frozenset()
        sets.append(s)
        if not s:
            continue
        if s in seen:
            parent[find(i)] = find(seen[s])
            continue
        seen[s] = i
        for o, n in Counter(o for t in s for o in where[t]).items():
            if den * n >= num * (len(s) + len(sets[o]) - n):
                parent[find(i)] = find(o)
        for t in s:
            where[t].append(i)
    group = defaultdict(list)
    for i in range(len(rows)):
        group[find(i)].append(rows[i][0])
    return sorted((str(rows[i][0]), len(sets[i]), min((x for x in group[find(i)] if x is not None), default=None)) for i in range(len(rows)))


def near_copies(rows):
    random.seed(1)
    own = [t for _, t in rows[:30] if t]
    out = []
    for i in range(250):
        w = random.choice(own).split()[: random.choice([1, 2, 3, 4, 5, 8, 20, 60])]
        for _ in range(random.choice([0, 0, 1, 1, 2])):
            if w:
                w[random.randrange(len(w))] = random.choice(["x", f"Z{random.randrange(50)}"])
        out.append((10_000 + i, " ".join(w)))
    big = own[0].split()[:120]
    for i in range(300):
        w = list(big)
        for _ in range(random.choice([0, 1, 2, 3])):
            w[random.randrange(len(w))] = f"q{random.randrange(9)}"
        out.append((20_000 + i, "\n".join(w).upper() if i % 3 else " ".join(w)))
    return out


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_equals_brute_force(spark, k, num):
    rows = odd_rows(spark)
    rows += near_copies(rows)
    got = j.similar(frame(spark, rows), k, num, 100).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got) == brute_force(rows, k, num)


def test_small_groups_and_buckets(spark, monkeypatch):
    """Many groups, chunks and buckets give the same."""
    for name, n in (("GROUP", 3), ("DEAL_TOKENS", 500), ("SPREAD", 3), ("BUCKET_TOKENS", 2000), ("NODES", 50), ("BROADCAST_IDS", 1)):
        monkeypatch.setattr(j, name, n)
    rows = odd_rows(spark)
    rows += near_copies(rows)[:400]
    got = j.similar(frame(spark, rows), 4, 85, 100).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got) == brute_force(rows, 4, 85)


def test_equals_sql(spark):
    compare(spark, queries.op8_ngram_jaccard_join, j.ORACLE)


def test_empty_table(spark):
    assert j.similar(frame(spark, [(1, "x")]).limit(0)).count() == 0
    assert j.similar(frame(spark, [(1, None), (2, ""), (3, "a b")])).where("doc_id = component_id").count() == 3


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
