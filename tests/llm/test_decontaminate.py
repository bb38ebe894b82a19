import hashlib
import random

import pytest
from helpers import documents, frame, odd_rows
from oracle import compare

from loomspan.llm import decontaminate as d
from loomspan.llm import queries

ITEMS = "item_id long, text string, extra int"


def check(spark, rows, items):
    table = spark.createDataFrame([(i, t, None) for i, t in items], ITEMS)
    got = d.digests(d.decontaminate(frame(spark, rows), table)).collect()
    want = []
    for i, t in rows:
        n, hit, ids = d.brute_force(t, items)
        want.append((str(i), n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0))
    assert sorted((str(r[0]), *tuple(r)[1:6]) for r in got) == sorted(want)
    return got


def items_of(rows):
    random.seed(2)
    out = []
    for k in range(40):
        words = d.item_words(random.choice(rows)[1])
        at = random.randrange(max(1, len(words) - 30))
        out.append((k, " ".join(words[at : at + random.choice([1, 4, 9, 10, 11, 25])]).upper()))
    return out + [(100, None), (101, ""), (102, "..."), (None, out[0][1]), (3, out[5][1]), (3, out[5][1])]


def test_equals_brute_force(spark):
    rows = odd_rows(spark)
    got = check(spark, rows, items_of([r for r in rows if r[1]]))
    assert any(r["contaminated"] for r in got)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_BYTES", 300)
    rows = documents(spark)[:60] + [(1, "a b c")]
    check(spark, rows, items_of(rows))


def test_windows_do_not_cross_documents(spark):
    check(spark, [(1, "a b c d e"), (2, "f g h i j"), (3, "a b c d e f g h i j"), (4, "x a-b_c'd.e f!g h?i j")], [(7, "a b c d e f g h i j")])


def test_proximity(spark):
    words = [f"w{i}" for i in range(12)]
    item = spark.createDataFrame([(1, " ".join(words[:10]), None)], ITEMS)
    rows = [(1, " ".join(words[:5] + ["zz"] + words[5:10])), (2, " ".join(words[:10])), (3, "nothing here")]
    got = {r["doc_id"]: (r["items"], r["near_items"]) for r in d.decontaminate(frame(spark, rows), item).collect()}
    assert got == {1: ([], ["1"]), 2: (["1"], []), 3: ([], [])}


def test_equals_sql(spark):
    compare(spark, queries.op4_benchmark_decontamination, d.ORACLE)


@pytest.mark.parametrize("which", ["documents", "items"])
def test_empty_tables(spark, which):
    rows, items = documents(spark)[:3], [(1, "a b")]
    table = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows)
    got = d.digests(d.decontaminate(docs.limit(0) if which == "documents" else docs, table.limit(0) if which == "items" else table)).collect()
    assert len(got) == (0 if which == "documents" else 3) and not any(r["contaminated"] for r in got)
