import numpy as np
import zlib
from helpers import frame, odd_rows

from loomspan.llm import quality_pu, queries, toxicity
from loomspan.llm.linear import minimise

SF = "/root/testdata/sf0.1"


def auc(score, label):
    rank = np.empty(len(score))
    rank[np.argsort(score)] = np.arange(1, len(score) + 1)
    p = label.sum()
    return (rank[label == 1].sum() - p * (p + 1) / 2) / (p * (len(label) - p))


def held_out(spark, query, column, parts, which):
    labels = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = query(spark, SF).collect()
    assert len(rows) == 10_000
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == which)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    own = [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    s, y, p = (np.array(x) for x in zip(*own, strict=True))
    return auc(s, y), (p == y).mean(), p[y == 1].mean(), p[y == 0].mean()


def test_quality_on_held_out_rows(spark):
    a, accuracy, _, wrong = held_out(spark, queries.op3_quality_classifier, "quality", 3, 1)
    assert a > 0.99 and accuracy > 0.98 and wrong < 0.05


def test_toxicity_on_held_out_rows(spark):
    a, accuracy, caught, wrong = held_out(spark, queries.op6_toxicity, "toxic", 5, 0)
    assert a > 0.97 and accuracy > 0.96 and caught > 0.8 and wrong < 0.01


def test_odd_rows_get_scores(spark):
    rows = odd_rows(spark)
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, k % 2, k % 3 == 0 and 1 or 0) for k, (i, _) in enumerate(rows)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for module in (quality_pu, toxicity):
        got = module.classify(docs, labels).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        none = [r["score"] for r in got if r["doc_id"] in (1000, 1001)]
        assert len(set(none)) == 1
        assert not any(r["held_out"] for r in got if r["doc_id"] is None)
        assert module.classify(docs, labels.limit(0)).where("predicted = 0").count() == len(rows)
        assert module.classify(docs.limit(0), labels).count() == 0


def test_scores_ignore_other_columns_and_keep_them(spark):
    docs = frame(spark, odd_rows(spark)).withColumnRenamed("score", "toxicity")
    model = toxicity.fit([np.array([1], np.int32), np.array([2], np.int32)], np.array([0, 1]))
    got = toxicity.score(docs, model)
    assert sorted(got.columns) == sorted(docs.columns) and got.where("toxicity is null").count() == 0


def test_ngrams_against_plain_python():
    texts = ["abcdefg abcdefg", "", "abc", "ÄBCDé"]
    raw = [t.encode().lower() for t in texts]
    data = np.frombuffer(b"".join(t.encode() for t in texts), np.uint8)
    offsets = np.cumsum([0, *map(len, raw)])
    for r, g in zip(raw, toxicity.ngrams(data, offsets), strict=True):
        assert len(g) == len(set(g.tolist())) <= len({r[i : i + n] for n in toxicity.SIZES for i in range(len(r) - n + 1)})
        assert bool(len(g)) == (len(r) >= 4)


def test_nonnegative_risk_separates():
    rng = np.random.default_rng(0)
    pos, neg = rng.normal(1, 1, (400, 5)), rng.normal(-1, 1, (150, 5))
    unlabelled = np.concatenate([rng.normal(1, 1, (350, 5)), neg]).astype(np.float32)
    m = quality_pu.fit(pos.astype(np.float32), quality_pu.moments_of(unlabelled), 0.7)
    assert m.score(pos).mean() > 0.8 > 0.4 > m.score(neg).mean()


def test_minimise():
    a = np.diag([1.0, 10, 100])
    x = minimise(lambda v: (float(v @ a @ v / 2 - v.sum()), a @ v - 1), np.zeros(3), 100)
    assert np.allclose(x, [1, 0.1, 0.01], atol=1e-3)


def test_prior_from_positives_and_unlabelled_texts():
    """The share of positives in a mixture, told from it and from positives alone."""
    q, rng = quality_pu, np.random.default_rng(1)
    count = lambda m, x: np.bincount(q.bins_of(m.score(x)), minlength=q.BINS)
    for share in (0.3, 0.6, 0.9):
        n = int(2000 * share)
        pos = rng.normal(1.5, 1, (1500, 4)).astype(np.float32)
        mixed = rng.permutation(np.concatenate([rng.normal(1.5, 1, (n, 4)), rng.normal(-1.5, 1, (2000 - n, 4))])).astype(np.float32)
        asked = q.fit(pos[::2], q.moments_of(mixed[::2]), 0.5)
        assert abs(q.prior_of(count(asked, pos[1::2]), count(asked, mixed[1::2])) - share) < 0.07
    assert q.prior_of(count(asked, pos[:1]), count(asked, mixed)) == 0.5


def test_quality_is_fitted_on_every_document(spark):
    """The moments that the executors add up are those of all rows, whatever their number and partitions."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select(F.pmod("doc_id", F.lit(2)).cast("int").alias("half"), "text").limit(6000)
    rows = docs.collect()
    got = quality_pu._moments(docs.repartition(7))
    for h in (0, 1):
        raw = [(r["text"] or "").encode() for r in rows if r["half"] == h]
        x = np.concatenate([quality_pu.features(np.frombuffer(b"".join(raw[i : i + 200]), np.uint8), np.cumsum([0, *map(len, raw[i : i + 200])])) for i in range(0, len(raw), 200)])
        assert got[h][-1, -1] == len(raw) > 2000 and np.allclose(got[h], quality_pu.moments_of(x), rtol=1e-3, atol=1e-2)


def test_toxicity_training_on_executors_equals_training_in_one_place(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    from pyspark.sql import functions as F

    got = toxicity.train(docs, labels, "toxic", F.lit(True))
    rows = sorted((r["doc_id"], r["text"], r["toxic"]) for r in docs.join(labels, "doc_id").select("doc_id", "text", "toxic").collect())
    raw = [t.encode() for _, t, _ in rows]
    want = toxicity.fit(list(toxicity.ngrams(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))), np.array([y for _, _, y in rows]))
    assert len(rows) < 2 * toxicity.PER_CLASS and np.allclose(got.weights, want.weights, atol=1e-4) and abs(got.intercept - want.intercept) < 1e-3
