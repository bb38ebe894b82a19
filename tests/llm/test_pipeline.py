import corpus_pipeline as pipeline
from helpers import documents, frame
from test_jaccard import brute_force
from test_packing import check
from test_pii import plain

from loomspan.llm import decontaminate, toxicity
from loomspan.llm.common import durable, read_table

SF = "/root/testdata/sf0.01"


def test_stages_do_what_they_say(spark):
    docs = read_table(spark, SF, "documents")
    columns = docs.columns
    tables = [docs]
    for name, stage in pipeline.STAGES:
        tables.append(durable(stage(spark, tables[-1], SF), f"test-{name}"))
    ids = [{r["doc_id"] for r in t.select("doc_id").collect()} for t in tables]
    assert all(t.columns == columns for t in tables[:-1])
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))

    scores = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, read_table(spark, SF, "labels")).collect()}
    assert ids[1] == {i for i, s in scores.items() if s < pipeline.TOXIC}

    rows = [(r["doc_id"], r["text"]) for r in tables[1].collect()]
    assert ids[2] == {c for i, _, c in brute_force(rows, 5, 80)}

    items = [(r["item_id"], r["text"]) for r in read_table(spark, SF, "benchmark").collect()]
    windows = decontaminate.windows_of(items)
    sizes = {len(w) for w in windows}
    rows = [(r["doc_id"], decontaminate.item_words(r["text"])) for r in tables[2].collect()]
    assert ids[3] == {i for i, w in rows if not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))}

    assert ids[4] == ids[3]
    before = {r["doc_id"]: r["text"] for r in tables[3].collect()}
    after = {r["doc_id"]: (r["text"], r["n_chars"]) for r in tables[4].collect()}
    for i, (text, n) in after.items():
        assert n == len(text) and not any(k in ("email", "ip", "card") for k, _, _ in plain(text))
        assert (text == before[i]) or plain(before[i]) or "<" in text

    assert check([(i, t) for i, (t, _) in after.items()], tables[5].collect()) < 0.05


def test_null_ids_and_repeats(spark):
    rows = documents(spark)[:20]
    text = rows[3][1]
    docs = frame(spark, [*rows, (None, text), (None, "a new text"), (None, None), rows[4], rows[4]]).select("doc_id", "text", "lang", "source", "n_chars")
    kept = pipeline.drop_near_copies(spark, docs, SF)
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(got) == len(set(got)) and (None, "a new text") in got and sum(t == text for _, t in got) == 1
    assert pipeline.drop_contaminated(spark, docs, SF).count() == docs.count()
    assert pipeline.drop_near_copies(spark, docs.limit(0), SF).count() == 0


def test_rows_are_told_apart_by_number(spark):
    texts = [t for _, t in documents(spark) if t and len(t) > 200][:6]
    rows = [(42, texts[0]), (None, None), (None, ""), (None, ""), (7, texts[1]), (7, texts[2]), (8, texts[2]), (9, None), (9, None), (None, texts[0])]
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    got = [(r["doc_id"], r["text"]) for r in pipeline.drop_near_copies(spark, docs, SF).collect()]
    want = [(42, texts[0]), (None, None), (None, ""), (None, ""), (7, texts[1]), (7, texts[2]), (9, None), (9, None)]
    assert sorted(got, key=str) == sorted(want, key=str)
    item = spark.createDataFrame([(1, texts[2])], "item_id long, text string")
    real, pipeline.read_table = pipeline.read_table, lambda *_: item
    try:
        got = [(r["doc_id"], r["text"]) for r in pipeline.drop_contaminated(spark, docs, SF).collect()]
    finally:
        pipeline.read_table = real
    assert sorted(got, key=str) == sorted([r for r in rows if r[1] != texts[2]], key=str)


def test_whole_pipeline_on_empty_tables(spark, tmp_path):
    """Each table empty in turn, and all of them: no stage fails, and without documents there are no pieces."""
    small = "/root/testdata/sf0.001"
    for empty in (["documents"], ["labels", "benchmark"]):
        folder = tmp_path / "-".join(empty)
        for name in ("documents", "labels", "benchmark"):
            table = read_table(spark, small, name)
            (table.limit(0) if name in empty else table.limit(60)).write.parquet(f"{folder}/{name}.parquet")
        got = pipeline.run(spark, str(folder))
        assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(got.columns)
        assert (got.count() == 0) == ("documents" in empty)


def test_columns_of_any_name_stay(spark):
    """Names that operators use inside are columns like others, and all but the last stage give them back."""
    names = ["toxicity", "candidates", "found", "base_spans", "all_spans", "component_id", "count", "first", "sig", "shard", "row_key", "Other_Columns", "score", "a.b"]
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    wide = docs.select("*", *[docs["doc_id"].cast("string").alias(n) for n in names])
    for _, stage in pipeline.STAGES[:-1]:
        wide = stage(spark, wide, "/root/testdata/sf0.001")
        assert wide.columns == [*docs.columns, *names]
    rows = wide.collect()
    assert rows and all(r[n] == str(r["doc_id"]) for r in rows for n in names)
