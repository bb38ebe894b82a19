"""Small tables with the cases that every operator must handle."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long, label int, score double"
SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    """Documents with extra columns, some of whose names clash with what operators use inside."""
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), None, None) for i, t in rows], DOC).repartition(3)


def documents(spark, sf_dir=SF):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def odd_rows(spark):
    """Some real texts, and null, empty and very long ones, ties, repeated rows, null ids."""
    random.seed(11)
    own = documents(spark)[:40]
    long = " ".join(random.choice(["lorem", "ipsum", "dolor", "sit,", "Amet.", "ünïcode", "😀"]) + str(random.randrange(99)) for _ in range(30_000))
    odd = [(1000, None), (1001, ""), (1002, " \n\t"), (1003, long), (1004, "x"), (1005, own[0][1]), (1005, own[0][1]), (None, own[1][1]), (None, None), (1006, "a b c d"), (1007, "A  B\nC d")]
    return own + odd
