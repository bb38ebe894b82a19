"""The two jobs: reruns, growing input, and results against plain models."""

import json
import re

import pytest
from oracle import SMALL, compare

import __spark_entry__ as entry
from jobs import annotation_release, text_intake
from jobs.common import settings

DOC = "doc_id long, text string, lang string, source string"
REC = "c\ts\t{}\t1\t9\t.\t+\t.\tx"
TEXTS = [
    (1, "##gff-version 3\n" + REC.format("exon") + "\n# c\n\nbroken\tline\n" + REC.format("CDS") + "\n##FASTA\n>s\n" + REC.format("gene"), "en"),
    (2, REC.format("exon") + "\r\n\r\n" + "plain prose", "fr"),
    (3, None, None),
    (4, "", "en"),
    (5, "\n", "de"),
    (6, "a\t\tb\t1\t2\t.\t+\t.\tx\n\ta\tb\tc\td\te\tf\tg\th\ti\tj", "de"),
    (7, "##FASTA\n##gff-version 3", "de"),
    (8, "x" * 100_000 + "\n" + "y\t" * 10_000 + "z", "en"),
]


def model(text):
    """What the reader says of a text, line by line."""
    def lines(breaks):
        parts = re.split(breaks, text or "")
        return parts[:-1] if parts[-1] == "" else parts

    own = lines("\n")
    cut = next((i for i, x in enumerate(own, 1) if x.startswith("##FASTA")), None)
    head = own if cut is None else own[: cut - 1]
    kinds = ["skipped" if x == "" or x[0] == "#" else "record" if len([t for t in x.split("\t") if t]) >= 9 else "error" for x in head]
    features = sorted({[t for t in x.split("\t") if t][2] for x, k in zip(head, kinds, strict=True) if k == "record"})
    malformed = sum(1 for x in lines("\r\n|\r|\n") if x and x[0] != "#" and len(x.split("\t")) < 9)
    fmt = "gff3" if any(x.startswith("##gff-version") for x in head) else "gtf"
    return (len(own), cut, fmt, kinds.count("skipped"), kinds.count("record"), kinds.count("error"), kinds.index("error") + 1 if "error" in kinds else None, ",".join(features), malformed)


COLUMNS = ("n_lines", "cut_line", "format", "n_skipped", "n_records", "n_errors", "first_error", "features", "n_malformed")


def read(table):
    return {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in table.collect()}


def write(spark, path, rows):
    spark.createDataFrame([(i, t, lang, "s") for i, t, lang in rows], DOC).coalesce(1).write.mode("append").parquet(path)


def test_intake_takes_only_what_is_new(spark, tmp_path):
    table, output, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    run = lambda: text_intake.run(spark, table, output, checkpoint, files_per_batch=1)
    write(spark, table, TEXTS[:3])
    assert read(run()) == {i: model(t) for i, t, _ in TEXTS[:3]}
    first = {r["batch"] for r in spark.read.parquet(output).select("batch").distinct().collect()}
    assert read(run()) == {i: model(t) for i, t, _ in TEXTS[:3]}  # nothing new, nothing changed
    write(spark, table, TEXTS[3:6])
    write(spark, table, TEXTS[6:])
    got = run()
    assert got.count() == len(TEXTS) and read(got) == {i: model(t) for i, t, _ in TEXTS}
    later = {r["doc_id"]: r["batch"] for r in got.collect()}
    assert {later[i] for i, _, _ in TEXTS[:3]} == first and not first & {later[i] for i, _, _ in TEXTS[3:]}
    assert {r["lang"] for r in got.collect()} == {"en", "fr", "de", None}


def test_intake_survives_a_failed_batch(spark, tmp_path, monkeypatch):
    """A batch that fails after it has written is taken again, and stands once."""
    table, output, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    write(spark, table, TEXTS)
    real = text_intake.LOG.info

    def fail(text, *a):
        if text.startswith("batch"):
            raise RuntimeError("lost")
        real(text, *a)

    monkeypatch.setattr(text_intake.LOG, "info", fail)
    with pytest.raises(Exception, match="lost"):
        text_intake.run(spark, table, output, checkpoint)
    monkeypatch.setattr(text_intake.LOG, "info", real)
    got = text_intake.run(spark, table, output, checkpoint)
    assert got.count() == len(TEXTS) and read(got) == {i: model(t) for i, t, _ in TEXTS}


def test_release_reruns_and_replaces_parts(spark, tmp_path):
    out, before = str(tmp_path / "out"), spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    rows = lambda t: sorted(map(tuple, t.collect()))
    whole = rows(annotation_release.run(spark, SMALL, out))
    assert rows(annotation_release.run(spark, SMALL, out)) == whole
    assert rows(annotation_release.run(spark, SMALL, out, ["chr2", "chr4"])) == whole  # only their partitions are written again
    some = str(tmp_path / "some")
    annotation_release.run(spark, SMALL, some, ["chr2"])
    both = annotation_release.run(spark, SMALL, some, ["chr4"])
    assert {r["seqname"] for r in both.collect()} == {"chr2", "chr4"}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before


def test_release_of_files(spark, tmp_path):
    """Two annotations as files: comments, broken lines and what stands behind the sequence section do no harm, and an empty release leaves all unique."""
    row = "c{}\ts\texon\t{}\t{}\t.\t+\t.\tgene_id \"{}\"; transcript_id \"{}\";"
    one = ["##gff-version 3", row.format(1, 100, 200, "g", "t1"), row.format(1, 300, 400, "g", "t1"), row.format(2, 5, 9, "h", "t2"), "bad"]
    two = [row.format(1, 150, 200, "g", "u1"), "##FASTA", row.format(1, 300, 450, "g", "u1"), row.format(2, 10, 20, "h", "u2")]
    for name, text in (("a", one), ("b", two), ("none", ["# nothing"])):
        (tmp_path / name).write_text("\n".join(text) + "\n")
    job = lambda a, b, out: annotation_release.compare(spark, annotation_release.lines_of_files(spark, str(tmp_path / a), str(tmp_path / b)), str(tmp_path / out))
    got = {(r["src"], r["tx_id"]): (r["seqname"], r["locus"], r["cmp_class"], r["n_introns"]) for r in job("a", "b", "o1").collect()}
    assert got == {(1, "t1"): ("c1", 1, "=", 1), (2, "u1"): ("c1", 1, "=", 1), (1, "t2"): ("c2", 1, "u", 0), (2, "u2"): ("c2", 2, "u", 0)}
    assert {r["cmp_class"] for r in job("a", "none", "o2").collect()} == {"u"}
    assert job("none", "none", "o3").count() == 0


@pytest.mark.parametrize("name", ["job1_annotation_release", "job2_text_intake"])
def test_query_equals_its_sql(spark, name):
    compare(spark, entry.queries()[name], entry.oracle_sql()[name])


def test_settings(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"input": "a", "output": "b", "sequences": ["chr1"]}))
    given = type("Given", (), {})()
    given.config, given.input, given.output = str(tmp_path / "c.json"), None, "elsewhere"
    assert settings(spark, given) == {"input": "a", "output": "elsewhere", "sequences": ["chr1"]}
