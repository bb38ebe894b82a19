import random
import re
from collections import Counter

import pytest
from helpers import DOC, SF
from oracle import compare

from loomspan.llm import collocations as c
from loomspan.llm import queries

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute_force(rows, top=2000):
    counts, total = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        f = counts.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate({x: x + 32 for x in range(65, 91)})):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            f.update(" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if " " in p and a >= 10}
        over = Counter()
        for p, a in found.items():
            v = p.split(" ")
            for q in (v[:2], v[1:]) if len(v) == 3 else ():
                over[" ".join(q)] = max(over[" ".join(q)], a)
        own = []
        for p, a in found.items():
            if 100 * over[p] >= 50 * a:
                continue
            v = p.split(" ")
            score, _, left, right = min((1_000_000 * a * a // (f[x] * f[y]), k, f[x], f[y]) for k in range(1, len(v)) for x, y in ((" ".join(v[:k]), " ".join(v[k:])),))
            own.append((-score, -a, p.encode(), p, a, left, right, score))
        out += [(lang, i, p, a, left, right, total[lang], s) for i, (_, _, _, p, a, left, right, s) in enumerate(sorted(own)[:top], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, 1, None, None) for i, (t, lang) in enumerate(rows)], DOC).repartition(3)


def plain(df):
    return sorted(tuple(r[x] for x in COLUMNS) for r in df.collect())


def texts(n=120):
    random.seed(5)
    words = [f"w{i}" for i in range(60)] + ["Über", "ñandú", "😀", "x-y", "don't"]
    weight = [1 / (i + 1) for i in range(len(words))]
    ends = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0c", "!? ", " "]
    return [("".join(random.choices(words, weight)[0] + random.choice(ends) for _ in range(random.choice([1, 2, 5, 80, 300]))), random.choice(["en", "en", "de", None, "und", ""])) for _ in range(n)]


def odd():
    return [(None, "en"), ("", "en"), (" \t\n", None), ("a", "xx"), ("a a a a a a a a a a a a", "aa"), ("w1 W2 w3 " * 20_000, "en"), *[("same words HERE, again.", "fr")] * 12]


def test_equals_brute_force(spark):
    rows = texts() + odd()
    assert plain(c.mine(frame(spark, rows))) == brute_force(rows)


@pytest.mark.parametrize(("bits", "flush", "top"), [(64, 100, 2000), (1, 1000, 5), (1 << 28, 50, 7)])
def test_folded_bits_and_small_flushes_lose_nothing(spark, bits, flush, top):
    rows = texts(60)
    assert plain(c.mine(frame(spark, rows), c.Sketch(width=1 << 10, bits=bits, flush=flush), top)) == brute_force(rows, top)


def test_a_sketch_lets_few_rare_phrases_through(spark):
    """Of phrases that occur once, almost none reach the exact count."""
    rows = [(" ".join(f"v{i}x{j}" for j in range(500)), "en") for i in range(40)] + [("new york city", "en")] * 15
    own = frame(spark, rows).select("lang", "text")
    sketch = c.Sketch()
    bits = c._heavy(c._first_pass(own, sketch), sketch)
    got = {r["phrase"] for r in c._second_pass(own, bits, sketch).select("phrase").distinct().collect()}
    assert {"new york", "york city", "new york city"} <= got and len(got) < 20


def test_exact_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", "a b", 2, 9_000_000_000_000)], "lang string, phrase string, k int, a long")
    words = spark.createDataFrame([("en", "a", 9_000_000_000_001), ("en", "b", 9_000_000_000_007)], "lang string, word string, f long")
    assert c.scores(counts, words).first()["score"] == 1_000_000 * 9_000_000_000_000**2 // (9_000_000_000_001 * 9_000_000_000_007)


def test_equals_sql(spark):
    compare(spark, queries.op11_collocations, c.ORACLE)
    assert queries.op11_collocations(spark, SF).count() > 100


def test_empty_table(spark):
    assert c.mine(frame(spark, [("x", "en")]).limit(0)).count() == 0
    assert c.mine(frame(spark, [(None, None), ("one", "en")])).count() == 0
