"""Files: marks in one pass, print in one run, streams with the sequence section, paths that can't be opened, the Venn picture."""

import sys
import types

import pytest
from pyspark.sql import functions as F

from loomspan import cli
from loomspan.operators import select
from loomspan.plans import reports
from loomspan.sources import lines as src
from loomspan.sources import records as rec
from loomspan.streaming.records import table_stream

REC = "c\ts\t{}\t{}\t9\t.\t+\t.\tgene_id \"g\";"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "in"
    at.mkdir()
    (at / "a.gff").write_text("\n".join([REC.format("exon", 1), "##gff-version 3", "# c", "bad", REC.format("CDS", 2), "##FASTA", REC.format("late", 3)]) + "\n")
    (at / "b.gtf").write_text("\n".join([REC.format("exon", i) for i in range(1, 400)] + ["##FASTA", "##gff-version 3"]) + "\n")
    (at / "empty.gtf").write_text("")
    return at


def kinds(df):
    out = {}
    for r in df.collect():
        key = (r["path"].rsplit("/", 1)[1], r["format"], r["line_kind"])
        out[key] = out.get(key, 0) + 1
    return out


WANT = {("a.gff", "gff3", "record"): 2, ("a.gff", "gff3", "skipped"): 2, ("a.gff", "gff3", "error"): 1, ("b.gtf", "gtf", "record"): 399}


def test_marks_take_one_pass_and_lines_another(spark, folder):
    table = src.table_lines(src.read_lines(spark, str(folder)))
    assert kinds(rec.parse_lines(table)) == WANT
    assert plan(table).count("Scan text") == 1 and plan(src.file_marks(src.read_lines(spark, str(folder)))).count("Scan text") == 1


def test_streamed_files_equal_the_batch(spark, folder, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    assert kinds(table_stream(spark, str(folder), out, check, files_per_trigger=1)) == WANT
    (folder / "c.gff").write_text("##gff-version 3\n" + REC.format("exon", 5) + "\n##FASTA\nACGT\n")
    later = WANT | {("c.gff", "gff3", "record"): 1, ("c.gff", "gff3", "skipped"): 1}
    for _ in range(2):
        assert kinds(table_stream(spark, str(folder), out, check)) == later
    batch = rec.parse_lines(src.table_lines(src.read_lines(spark, str(folder)))).drop("value", "line_ord", "block_start")
    streamed = spark.read.parquet(out).select(batch.columns)
    assert streamed.exceptAll(batch).isEmpty() and batch.exceptAll(streamed).isEmpty()


def test_print_counts_as_it_writes(spark, folder, tmp_path, capsys):
    a = str(folder / "a.gff")
    assert cli.main(["print", a], spark) == 1
    shown = capsys.readouterr()
    assert cli.main(["print", a, "--out", str(tmp_path / "o")], spark) == 1
    written = capsys.readouterr()
    assert shown.err.splitlines()[-1] == written.err.splitlines()[-1] == "parsed=2  skipped=2  errors=1  format=gff3"
    assert [r["value"] for r in spark.read.text(str(tmp_path / "o")).collect()] == shown.out.splitlines() == [REC.format("exon", 1), REC.format("CDS", 2)]
    assert cli.main(["print", str(folder / "empty.gtf")], spark) == 0
    assert "parsed=0  skipped=0  errors=0  format=gtf" in capsys.readouterr().err


@pytest.mark.parametrize(("argv", "code"), [("", 1), ("print", 1), ("filter exon", 1), ("compare one.gtf", 1), ("unknown one.gtf", 1), ("overlap chr1 one.gtf", 1), ("overlap chr1:9-5 one.gtf", 1), ("overlap chr1:1,000-2,000 one.gtf", 1), ("print /no/such/file.gtf", 1), ("compare /no/such/file.gtf /no/other", 1), ("ids one.gtf", 2), ("ids one.gtf two.gtf --output all", 2)])
def test_arguments(spark, argv, code, capsys):
    assert cli.main(argv.split(), spark) == code
    assert capsys.readouterr().out == ""


def test_files_that_cannot_be_opened(spark, folder, tmp_path, capsys, monkeypatch):
    (tmp_path / "loop").symlink_to(tmp_path / "nowhere")
    assert cli.main(["print", str(tmp_path / "loop")], spark) == 1 and "error" in capsys.readouterr().err
    assert cli.unreadable(spark, str(folder)) is None and cli.unreadable(spark, str(folder / "*.gtf")) is None
    (folder / ".a.gff.crc").write_bytes(b"crc\0" + b"\0" * 12)  # a checksum that the file does not have: it opens, and reading it fails
    assert cli.unreadable(spark, str(folder / "a.gff")) is None


def test_numbers_beyond_their_range(spark):
    line = "c\ts\texon\t{}\t{}\t.\t+\t{}\tx"
    texts = [line.format("9223372036854775808", "-9223372036854775809", "4294967295"), line.format("9223372036854775807", "+12x", "2147483648"), line.format("99999999999999999999999", "", "1")]
    rows = rec.parse_lines(spark.createDataFrame([(t,) for t in texts], "value string")).select("start", "end", "frame").collect()
    top = (1 << 63) - 1
    assert [tuple(r) for r in rows] == [(top, -top - 1, None), (top, 12, -(1 << 31)), (None, None, None)]  # the third has eight tokens


def test_region_column_equals_the_parser(spark):
    texts = ["chr1:100-200", "chr1:alt:5-9", "chr1:5-9xyz", "chr1:1,000-2,000", "chr1:9-5", "chr1", ":1-2", "c: -7- +8", "c:1 -2", "x" * 255 + ":1-2", "x" * 256 + ":1-2", "c:1-", "c:--1-2", "c\n:1-2", ""]

    def parsed(t):
        try:
            r = select.parse_region(t)
            return (r.seqname, r.start, r.end)
        except ValueError:
            return None

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", select.region_columns(F.col("t")).alias("r")).orderBy("i").collect()
    assert [None if r["r"] is None else tuple(r["r"]) for r in got] == [parsed(t) for t in texts]


def test_venn_picture(spark, tmp_path, monkeypatch):
    """The picture gets the three regions of each level; the plot library is stood in for where it is missing."""
    seen = []

    class Figure:
        def __init__(self, **options):
            pass

        def add_subplot(self, *place):
            return types.SimpleNamespace(set_xlabel=lambda text: seen.append(text))

        def savefig(self, path):
            open(path, "w").write("picture")

    for name, held in (("matplotlib", {}), ("matplotlib.figure", {"Figure": Figure}), ("matplotlib_venn", {"venn2": lambda regions, labels, ax: seen.append((regions, labels))})):
        module = types.ModuleType(name)
        vars(module).update(held)
        monkeypatch.setitem(sys.modules, name, module)
    summary = spark.createDataFrame([("gene", 5, 4, 3, 2, 1), ("transcript", 9, 9, 9, 0, 0)], "level string, n1 long, n2 long, shared long, only1 long, only2 long")
    assert reports.venn(summary, str(tmp_path / "v.png"), "A", "B") and (tmp_path / "v.png").read_text() == "picture"
    assert seen == [((2, 1, 3), ("A", "B")), "gene ids: 6", ((0, 0, 9), ("A", "B")), "transcript ids: 9"]
    monkeypatch.setitem(sys.modules, "matplotlib_venn", None)
    assert not reports.venn(summary, str(tmp_path / "w.png"), "A", "B")
