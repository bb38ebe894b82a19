import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import frame, odd_rows

from loomspan.llm import substring_dedup as s
from loomspan.llm.suffix_sort import PrefixHash, common_extension, suffix_sort

WORDS = ["alpha", "beta", "gamma", "ünï", "x", "yy", "zeta", "eta", "iota", "kappa"]


def text(n):
    return " ".join(random.choice(WORDS) + str(random.randrange(99)) for _ in range(n))


def planted():
    random.seed(3)
    passages = [text(random.choice([5, 12, 40, 90])) for _ in range(8)]
    docs = []
    for _ in range(150):
        parts = []
        for _ in range(random.choice([0, 1, 2, 3])):
            parts += [text(random.randrange(1, 60)), random.choice(passages)]
        docs.append(" ".join([*parts, text(3)]))
    for i in range(30):
        words = docs[i].split()
        words[random.randrange(len(words))] = "EDIT"
        docs.append(" ".join(words))
    return docs + docs[:10] + [None, "", "a" * 3000, "ab" * 700, "De " * 60 + text(30), text(50) * 3, passages[3] + text(4) + passages[3]]


@pytest.mark.parametrize(("length", "gram", "run", "run_gram", "hot"), [(400, 200, 50, 12, 6000), (64, 32, 12, 4, 3), (400, 200, 20, 5, 4)])
@pytest.mark.parametrize(("anchors", "deal"), [(1_000_000, 2000), (60, 20)])
def test_equals_brute_force(spark, length, gram, run, run_gram, hot, anchors, deal):
    docs = planted()
    found = s.remove_repeats(frame(spark, list(enumerate(docs))), s.Unit(length, gram), s.Unit(run, run_gram, words=True), hot, anchors, deal)
    got = {r["doc_id"]: tuple(r)[1:] for r in found.collect()}
    assert [got[i] for i in range(len(docs))] == s.brute_force(docs, length, run)


def test_copies_of_a_third_of_all_rows(spark):
    random.seed(8)
    passage, hot = text(80), text(120)
    docs = [hot if i % 3 == 0 else f"{text(9)} {passage if i % 3 == 1 else hot[:500]} {text(9)}" for i in range(120)]
    got = {r["doc_id"]: tuple(r)[1:] for r in s.remove_repeats(frame(spark, list(enumerate(docs)))).collect()}
    assert [got[i] for i in range(len(docs))] == s.brute_force(docs)
    assert all(got[i][1] for i in range(len(docs)))


def test_only_the_first_copy_of_a_task_travels():
    batch = pa.record_batch({"key": [b"a", b"b", b"a"], "text": ["x", "y", "x"]})
    assert [b.column("key").to_pylist() for b in s._first_of_task(iter([batch, batch]))] == [[b"a", b"b"], []]


def test_long_texts_in_parts(spark, monkeypatch):
    """Texts of many parts, whose anchors' stretches the part ends cut, give the same; so do tasks that send in several goes."""
    monkeypatch.setattr(s, "SLICE", 3000)
    monkeypatch.setattr(s, "FLUSH", 100)
    monkeypatch.setattr(s.parts_of, "__defaults__", (700,))
    random.seed(8)
    same = text(1500)
    docs = [text(2000), same + text(40), text(9) + same[:9000] + text(700) + same[500:2000], text(30) * 9, *planted()[:20]]
    units = (s.BYTES, s.PASSAGES)
    held = [(0, i, t.encode()) for i, t in enumerate(docs)]
    import hashlib

    import pyarrow as pa

    keys = [hashlib.sha256(raw).digest()[:16] for _, _, raw in held]
    rows = list(s._anchor_rows(units, 5)(iter([pa.record_batch({"key": pa.array(keys, pa.binary()), "text": docs})])))
    table = pa.Table.from_batches(rows)
    parts = [s._sort_out(units, 4)(table.filter(pa.array([b == x for b in table["bucket"].to_pylist()]))) for x in sorted(set(table["bucket"].to_pylist()))]
    found = pa.concat_tables(parts)
    asked = [[{"unit": u, "pos": p, "send": q, "hot": h} for k, u, p, q, h in zip(*(found[c].to_pylist() for c in ("key", "unit", "pos", "send", "hot")), strict=True) if k == key] for key in keys]
    around = pa.Table.from_batches(list(s._around_rows(units, 5)(iter([pa.record_batch({"key": pa.array(keys, pa.binary()), "text": docs, "asked": asked})]))))
    kind = around["kind"].to_pylist()
    spans = [found.select(["key", "unit", "start", "end"]), s._settle(units)(around.filter(pa.array([k == 0 for k in kind])))]
    hot = around.filter(pa.array([k == 1 for k in kind]))
    for u in (0, 1):
        own = hot.filter(pa.array([x == u for x in hot["unit"].to_pylist()]))
        if len(own):
            spans.append(s._meet_hot(units)(own))
    settled = around.filter(pa.array([k == 2 for k in kind])).select(["key", "unit", "refs", "places"]).rename_columns(["key", "unit", "start", "end"])
    every = [r for t in [*spans, settled] for r in t.to_pylist()]
    want = s.brute_force(docs)
    for key, doc, (_, removed, _, _, words) in zip(keys, docs, want, strict=True):
        own = [r for r in every if r["key"] == key]
        assert (s._covered(own, 0, len(doc.encode())).sum(), s._covered(own, 1, len(doc.split())).sum()) == (removed, words)


def test_odd_rows(spark):
    rows = odd_rows(spark)
    got = sorted((str(r[0]), *tuple(r)[1:]) for r in s.remove_repeats(frame(spark, rows)).collect())
    assert got == sorted((str(i), *x) for (i, _), x in zip(rows, s.brute_force([t for _, t in rows]), strict=True))


def test_empty_table(spark):
    assert s.remove_repeats(frame(spark, [(1, "x")]).limit(0)).count() == 0
    assert s.brute_force([]) == []


@pytest.mark.parametrize("letters", [1, 2, 20])
def test_suffix_order(letters):
    random.seed(letters)
    n = 1200
    data = np.array([97 + random.randrange(letters) for _ in range(n)], np.uint8)
    data[300:500] = data[800:1000]
    raw, start = data.tobytes(), np.arange(n)
    order = suffix_sort(PrefixHash(data), data, start, np.full(n, n))
    assert [raw[i:] for i in order] == sorted(raw[i:] for i in range(n))


def test_common_extension():
    data = np.frombuffer(b"abcabcabd", np.uint8)
    h = PrefixHash(data)
    assert common_extension(h, np.array([0, 0, 1]), np.array([3, 6, 2]), np.array([6, 3, 7])).tolist() == [5, 2, 0]
