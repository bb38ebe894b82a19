import hashlib
import re

from helpers import documents, frame, odd_rows

from loomspan.llm import pii, queries

ODD = ["a@b.c_d@e.f", "x@y", "a@b.c@d.e.f", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1111", "é𝄞 a.b@c.de 𝄞 1.2.3.4", "+1 (826) 555-4081 190.137.223.204 x", "+49 30 1234567", "9" * 20_000, "a." * 10_000 + "@b.c", "1 " * 10_000, "a@" + "b." * 10_000 + "c", "+" + "1" * 20 + " ()", "ẞ+1 2", "1.2.3.4" * 1000, "jo [at] mail [dot] com"]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain(text):
    out = []
    for kind in pii.KINDS:
        for m in re.finditer(pii.PLAIN[kind], text):
            v = m.group()
            d = re.sub("[^0-9]", "", v)
            if {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in v.split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]():  # noqa: B023
                out.append((kind, m.start(), m.end()))
    return out


def label(docs):
    found = pii.detect(docs)
    return pii.label(found, pii.fit(found))


def test_base_spans_and_more(spark):
    many = " ".join(f"a{i}@b.com 1.2.3.{i % 300} {i:013d}" for i in range(3000))
    rows = odd_rows(spark) + documents(spark)[40:] + [(5000 + i, t) for i, t in enumerate(ODD)] + [(6000, many)]
    got = pii.digests(label(frame(spark, rows))).collect()
    want = []
    for i, t in rows:
        p = plain(t or "")
        want.append((str(i), *[sum(k == kind for k, _, _ in p) for kind in pii.KINDS], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in p).encode()).hexdigest()))
    assert sorted((str(r[0]), *tuple(r)[1:6]) for r in got) == sorted(want)
    spans = {r["doc_id"]: set(filter(None, r["spans"].split(","))) for r in got}
    assert all({f"{k}:{a}:{b}" for k, a, b in plain(t or "")} <= spans[i] for i, t in rows if i is not None and i != 1005)


def test_added_spans(spark):
    """What the base rules drop because a match runs on, but labelers and classifier accept."""
    rows = documents(spark, "/root/testdata/sf0.01") + [(5000 + i, t) for i, t in enumerate(ODD) if len(t) < 1000]
    spans = {r["doc_id"]: r["spans"] for r in pii.digests(label(frame(spark, rows))).collect()}
    assert spans[5006] == "ip:18:33,phone:0:17" and spans[5015] == "email:0:22" and spans[5001] == ""


def test_redaction(spark):
    rows = [(1, "mail a@b.com, ip 10.0.0.1!"), (2, "nothing"), (3, None), (4, "é a@b.c")]
    got = {r["doc_id"]: r["text"] for r in pii.redact(label(frame(spark, rows))).collect()}
    assert got == {1: "mail <email>, ip <ip>!", 2: "nothing", 3: "", 4: "é <email>"}


def test_redaction_of_many_and_overlapping_spans(spark):
    """As a walk over the spans gives it, also with more spans than a block has."""
    import random

    random.seed(2)
    rows = []
    for i, n in enumerate((1, 5, 127, 128, 129, 700, 40_000)):
        spans = sorted((k, a, a + random.randint(1, 30)) for k, a in ((random.randrange(4), random.randrange(12 * n)) for _ in range(n)))
        rows.append((i, "".join(random.choice("aé𝄞 ") for _ in range(12 * n + 40)), spans))
    got = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame([(i, t, [], s) for i, t, s in rows], "doc_id long, text string, base_spans array<int>, all_spans array<struct<kind:int,start:int,end:int>>")).collect()}
    for i, text, spans in rows:
        out, at = [], 0
        for a, b, k in sorted((a, b, k) for k, a, b in spans):
            if a >= at:
                out += [text[at:a], f"<{pii.KINDS[k]}>"]
            at = max(at, b)
        assert got[i] == "".join(out) + text[at:]


def test_added_spans_overlap_no_base_span(spark):
    """The test on the spans of a kind in order equals a look at all of them."""
    import random

    random.seed(3)
    rows = []
    for i in range(60):
        n = random.choice([0, 1, 3, 50, 400])
        own = [(random.randrange(4), a, a + random.randint(1, 12), random.choice([0, 1, 2, 2]), [1, 1, 1, 1, 1]) for a in (random.randrange(6 * n + 1) for _ in range(n))]
        rows.append((i, own))
    df = spark.createDataFrame(rows, f"doc_id long, candidates array<{pii.SPAN}>")
    got = {r["doc_id"]: (r["base_spans"], r["all_spans"]) for r in pii.label(df, pii.Model(0.5, [], [], [1.0] * pii.N_FEATURES)).collect()}
    for i, own in rows:
        base = sorted(x[:3] for x in own if x[3] == 1)
        added = [x[:3] for x in own if x[3] == 2 and not any(k == x[0] and a < x[2] and x[1] < b for k, a, b in base)]
        assert [tuple(x) for x in got[i][0]] == base and [tuple(x) for x in got[i][1]] == sorted(base + added)


def test_no_two_labelers_are_one():
    for kind in pii.KINDS:
        sql = pii._candidates(kind, "base")
        votes = sql[sql.index("'votes', array(") :]
        assert pii.FORM[kind] in votes
        assert votes.count("w.good") == (0 if kind == "email" else 1)


def test_reliabilities_follow_the_votes(spark):
    rows = [(i, f"mail: a{i}@x.com tel: +1 (555) 555-{1000 + i} and version 1.2.3.400") for i in range(40)]
    m = pii.fit(pii.detect(frame(spark, rows)))
    checksum, context = pii.LABELERS.index("checksum"), pii.LABELERS.index("context")
    assert m.hit[checksum][2] > m.false[checksum][2] and m.hit[context][2] > m.false[context][2] and 0.01 <= m.prior <= 0.99


def test_added_spans_of_planted_data(spark):
    """Mail written with words for its signs, and cards and phones that the base patterns run past, among numbers that are none."""
    import random

    random.seed(6)
    rows, want = [], {}
    for i in range(400):
        own, kind = [f"write to jo{i} [at] mail{i} [dot] com now", f"order no {random.randrange(10**6)} of 2024", f"contact: a{i}@site{i}.org, thanks", "version 1.2.3.400 here", "just prose"][i % 5], i % 5
        rows.append((i, own))
        want[i] = kind == 0
    spans = {r["doc_id"]: r["spans"] for r in pii.digests(label(frame(spark, documents(spark) and [(10_000 + i, t) for i, t in documents(spark)] + rows))).collect()}
    found = {i: spans[i].startswith("email:9:") for i, _ in rows}
    assert all(found[i] for i in want if want[i])
    assert all(not spans[i] for i, _ in rows if i % 5 in (1, 3, 4))


def test_no_python_in_the_plan(spark):
    plan = queries.op10_pii(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_empty_table(spark):
    assert label(frame(spark, [(1, "x")]).limit(0)).count() == 0
    assert pii.digests(label(frame(spark, [(1, "x"), (2, None)]))).where("spans = ''").count() == 2
