from oracle import compare

from loomspan.llm import queries, url_filter

ENTRIES = "key string, action string, day int, reason string"
CAPTURES = "page_id long, url string, day int, html string"


def judge(spark, captures, entries):
    c = spark.createDataFrame([(*x, None) for x in captures], CAPTURES)
    return {r["page_id"]: (r["state"], r["matched_key"], r["blocked"]) for r in url_filter.judge(c, spark.createDataFrame(entries, ENTRIES)).collect()}


def test_equals_sql(spark):
    compare(spark, queries.op1_url_filters, queries.ORACLES["op1_url_filters"])


def test_as_of_and_specificity(spark):
    entries = [("bad.com", "block", 10, "a"), ("bad.com", "lift", 20, "b"), ("bad.com", "block", 30, "c"), ("ok.bad.com", "allow", 5, "d"), ("bad.com/x", "allow", 12, "e"), ("TIE.org", "block", 1, "p"), ("tie.org", "allow", 1, "q"), (None, "block", 1, ""), ("z.com", None, 1, ""), ("z.com", "block", None, "")]
    captures = [(1, "http://bad.com/", 9), (2, "http://bad.com/", 10), (3, "http://BAD.com:80/y?q", 19), (4, "http://bad.com", 20), (5, "http://bad.com", 31), (6, "https://u@ok.bad.com/", 15), (7, "http://w.bad.com/p", 15), (8, "http://bad.com/x/1", 15), (9, "http://tie.org", 1), (10, None, 5), (11, "nothing", 5), (12, "http://bad.com/", None), (13, "http://z.com", 3)]
    got = judge(spark, captures, entries)
    none = ("none", None, False)
    assert got == {1: none, 2: ("block", "bad.com", True), 3: ("block", "bad.com", True), 4: none, 5: ("block", "bad.com", True), 6: ("allow", "ok.bad.com", False), 7: ("block", "bad.com", True), 8: ("allow", "bad.com/x", False), 9: ("allow", "tie.org", False), 10: none, 11: none, 12: none, 13: none}


def test_repeats_and_empty(spark):
    c = spark.createDataFrame([(1, "http://a.com", 5, None)] * 3, CAPTURES)
    e = spark.createDataFrame([("a.com", "block", 1, "r")], ENTRIES)
    assert url_filter.judge(c, e).where("blocked").count() == 3
    assert url_filter.judge(c, e.limit(0)).where("blocked").count() == 0
    assert url_filter.judge(c.limit(0), e).count() == 0


def test_no_python_in_the_plan(spark):
    plan = queries.op1_url_filters(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow")) and "html" not in plan.split("== Physical Plan ==")[1]
