import pytest
from oracle import SMALL, compare

import __spark_entry__ as entry
from loomspan.plans import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, name):
    assert name in queries.ORACLES
    compare(spark, entry.queries()[name], queries.ORACLES[name])


def test_entry(spark):
    assert [r["n_tx"] for r in entry.entry(spark).orderBy("src").collect()] == [737, 736]


def test_known_figures(spark):
    """Figures that were worked out beforehand for the smallest tables."""
    q = entry.queries()
    counts = {r["src"]: r.asDict() for r in q["class_counts"](spark, SMALL).collect()}
    assert [counts[s][c] for c in ("n_exact", "n_partial", "n_overlap", "n_unique") for s in (1, 2)] == [23, 24, 329, 316, 313, 323, 72, 73]
    assert q["locus_sizes"](spark, SMALL).count() == 325
    assert q["introns_shared"](spark, SMALL).first()["n_shared"] == 471
    assert q["records_merge"](spark, SMALL).count() == 2745


def test_plans_stay_in_the_jvm_and_prune(spark):
    q = entry.queries()
    plan = lambda name: q[name](spark, SMALL)._jdf.queryExecution().toString()
    for name in ("exons", "class_counts", "tx_pair_class", "loci"):
        assert not any(x in plan(name) for x in ("Python", "CartesianProduct", "NestedLoop"))
    # What is compared is stored once; the tables are read where exons are made.
    read = plan("exons")
    assert "ReadSchema: struct<l_orderkey" in read and "l_comment" not in read.split("== Physical Plan ==")[1]
