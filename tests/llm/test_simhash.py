import random
import re

import numpy as np
import pytest
import xxhash
from helpers import documents, frame, odd_rows

from loomspan.llm import queries
from loomspan.llm import simhash as s


def plain_fingerprint(text):
    w = [a for a in re.split("[\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if a]
    h = [xxhash.xxh64(" ".join(w[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(len(w) - 3, 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps):
    """Least item of each item's component, by comparing all pairs."""
    fps = np.array(fps, np.uint64)
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4).tolist():
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def brute_force(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    root, least = classes(fps), {}
    for i, r in enumerate(root):
        if rows[i][0] is not None:
            least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    return sorted((str(d), f"{f:016x}", str(least.get(r))) for (d, _), f, r in zip(rows, fps, root, strict=True))


def plain(df):
    return sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in df.select("doc_id", "fingerprint", "component_id").collect())


def copies(rows):
    """A large family of near copies, and small ones."""
    random.seed(3)
    own = [t for _, t in rows[:30] if t]
    big, out = own[0].split()[:200], []
    for i in range(300):
        w = list(big)
        for _ in range(random.choice([0, 1, 2, 4])):
            w[random.randrange(len(w))] = f"q{random.randrange(99)}"
        out.append((20_000 + i, " ".join(w)))
    return out + [(30_000 + i, "A  b" if i % 2 else "a B c") for i in range(5)]


def test_equals_brute_force(spark):
    rows = odd_rows(spark)
    rows += copies(rows)
    assert plain(s.similar(frame(spark, rows))) == brute_force(rows)


def test_query_on_the_smallest_tables(spark):
    assert plain(queries.op12_simhash(spark, "/root/testdata/sf0.001")) == brute_force(documents(spark))


@pytest.mark.parametrize("sizes", [s.Sizes(), s.Sizes(part=7, fan=3, work=200), s.Sizes(part=50, stretch=300, fan=4, work=2000), s.Sizes(part=5, stretch=100, fan=2, group=1, meetings=2)])
def test_links_of_families(spark, sizes):
    """Small parts, tasks and nodes, and more blocks, join what all pairs join: balls of near fingerprints, chains, random ones."""
    random.seed(sizes.part)
    flip = lambda x, n: x ^ sum(1 << b for b in random.sample(range(64), n))
    fps = {0, (1 << 64) - 1, *(random.getrandbits(64) for _ in range(200))}
    for _ in range(5):
        c = random.getrandbits(64)
        fps |= {flip(c, random.choice([1, 2, 3, 5, 6])) for _ in range(80)}
    x = random.getrandbits(64)
    for _ in range(40):
        fps.add(x := flip(x, random.choice([3, 4, 4, 5])))
    fps = sorted(fps)
    rows = [(int(np.uint64(f).astype(np.int64)), i) for i, f in enumerate(fps)]
    edges, _ = s.links(spark.createDataFrame(rows, "fp long, first_id long").repartition(3), len(rows), sizes)
    at = {f: i for i, (f, _) in enumerate(rows)}
    root = list(range(len(fps)))
    for r in edges.collect():
        a, b = root[at[r["a"]]], root[at[r["b"]]]
        assert int(np.bitwise_count(np.uint64(fps[at[r["a"]]]) ^ np.uint64(fps[at[r["b"]]]))) <= 64
        root = [min(a, b) if v in (a, b) else v for v in root]
    assert root == classes(fps)


def test_ranks_turn_back_and_neighbours_differ_by_one_bit():
    x = np.random.default_rng(0).integers(0, 1 << 63, 100, dtype=np.uint64)
    for blocks in (5, 6, 8):
        for order, lead in s.tables(blocks):
            assert (s.bits_of(s.rank_of(x, order), order) == x).all() and lead >= 12
            assert (np.bitwise_count(s.bits_of(x, order) ^ s.bits_of(x + np.uint64(1), order)) == 1).all()


def test_empty_and_blank(spark):
    assert s.similar(frame(spark, [(1, "x")]).limit(0)).count() == 0
    assert plain(s.similar(frame(spark, [(3, None), (2, ""), (1, " \n")]))) == [(str(i), "0" * 16, "1") for i in (1, 2, 3)]


def test_a_very_long_text_is_counted_in_pieces(spark):
    text = " ".join(f"w{i * i % 1009}" for i in range(300_000))
    assert plain(s.similar(frame(spark, [(1, text), (2, "a")])))[0][1] == f"{s._long(np.array(s.fingerprint_of(text), np.uint64)):016x}"
