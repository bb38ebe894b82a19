import random

import pytest
from pyspark.sql import functions as F

from loomspan.functions import attributes as at
from loomspan.functions.numbers import six_digits
from loomspan.operators import select
from loomspan.sources import lines as src
from loomspan.sources import records as rec
from loomspan.sources.sinks import format_records, write_records

GOOD = 'NC_092344.1\tGnomon\texon\t31352\t31529\t.\t-\t.\tgene_id "LOC139519001"; transcript_id "XM_071310724.1";'


def parse(spark, *values):
    return rec.parse_lines(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, value string")).orderBy("i").collect()


def test_record_round_trip(spark):
    df = spark.createDataFrame([(GOOD,)], "value string")
    row = parse(spark, GOOD)[0]
    assert row["line_kind"] == "record" and row["score"] is None and row["frame"] is None
    assert format_records(rec.records(df)).first()["value"] == GOOD


@pytest.mark.parametrize(
    ("line", "kind"),
    [("# c", "skipped"), ("", "skipped"), (" ", "error"), ("\t\t", "error"), (" # x", "error"), ("\r", "error"), ("a\tb\tc\t1\t2\t.\t+\t.", "error"), ("a\t\tc\t1\t2\t.\t+\t.\tx", "error"), ("a\t\tc\t1\t2\t.\t+\t.\tx\ty", "record")],
)
def test_line_kinds(spark, line, kind):
    assert parse(spark, line)[0]["line_kind"] == kind


def test_lenient_numbers(spark):
    tail = "\tx\texon\t{}\t{}\t{}\t{}\t{}\tn"
    rows = parse(spark, *["c" + tail.format(*v) for v in [("12abc", "abc", ".5", "+x", "-1"), ("-5", " 7", "0.50", ".", "2x"), ("1", "2", "1e3x", "-", "."), ("1", "99999999999999999999", "inf", "-", "zz")]])
    assert [(r["start"], r["end"]) for r in rows] == [(12, 0), (-5, 7), (1, 2), (1, (1 << 63) - 1)]
    assert [r["score"] for r in rows] == [None, 0.5, 1000.0, float("inf")]
    assert [r["strand"] for r in rows] == ["+", ".", "-", "-"]
    assert [r["frame"] for r in rows] == [None, 2, None, 0]


def test_six_digits_equal_c(spark):
    random.seed(4)
    values = [0.5, 1234567.0, 1e-5, 100000.0, 1e6, 0.1, 2.5e-7] + [random.uniform(-1, 1) * 10 ** random.randint(-8, 8) for _ in range(500)]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double").select("i", F.col("v").cast("float").alias("v"))
    for r in df.withColumn("t", six_digits("v")).collect():
        assert r["t"] == "%g" % r["v"]


@pytest.mark.parametrize(
    ("raw", "listed", "token", "word"),
    [
        ('gene_id "G1"; transcript_id "T1";', "G1", "G1", "G1"),
        ("gene_id G2;", "G2", "G2", "G2"),
        ('gene_id  "two";', "two", "two", None),
        ('gene_id "";', "", "", '""'),
        ("gene_id;", "", "", None),
        ('ref_gene_id "Z"; gene_id "Y"', "Y", "Y", "Y"),
        ('ref-gene_id "Z"; gene_id "Y"', "Y", "Y", "Z"),
        ('note "a; gene_id "x"; gene_id "y";', "y", "x", "x"),
        ('gene_id "a"; gene_id "b";', "a", "a", "a"),
        ("other 1", None, "", None),
        ("", None, "", None),
    ],
)
def test_three_attribute_readings(spark, raw, listed, token, word):
    a = F.col("a")
    r = spark.createDataFrame([(raw,)], "a string").select(at.lookup(at.gtf_attributes(a), "gene_id"), at.token_id(a, "gene_id"), at.word_id(a, "gene_id")).first()
    assert tuple(r) == (listed, token, word)


def test_gff3(spark):
    a = F.col("a")
    df = spark.createDataFrame([("ID=e1;Parent=a,b; Is_circular;Note=x%20y=z;=5;",)], "a string")
    assert [tuple(p) for p in df.select(at.gff3_attributes(a)).first()[0]] == [("ID", "e1"), ("Parent", "a,b"), ("Is_circular", ""), ("Note", "x%20y=z")]


def _model(raw):
    """The GTF list grammar, step by step."""
    out, i, n = [], 0, len(raw)
    while i < n:
        while i < n and raw[i] in " \t":
            i += 1
        k = i
        while i < n and raw[i] not in " \t;":
            i += 1
        key = raw[k:i]
        while i < n and raw[i] in " \t":
            i += 1
        if i < n and raw[i] == '"':
            e = raw.find('"', i + 1)
            value, i = (raw[i + 1 :], n) if e < 0 else (raw[i + 1 : e], e + 1)
        else:
            k = i
            while i < n and raw[i] not in " \t;":
                i += 1
            value = raw[k:i]
        e = raw.find(";", i)
        i = n if e < 0 else e + 1
        if key:
            out.append((key, value))
    return out


def test_attribute_list_on_random_texts(spark):
    random.seed(7)
    texts = ["".join(random.choice('ab;; "\t') for _ in range(random.randrange(14))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "a string").select("a", at.gtf_attributes(F.col("a")).alias("p"))
    for r in df.collect():
        # a quote directly after a key without a blank belongs to the key in either reading
        assert [tuple(p) for p in r["p"]] == _model(r["a"]), r["a"]


def test_regions():
    assert select.parse_region("chr1:100-200") == select.Region("chr1", 100, 200)
    assert select.parse_region("chr1:alt:5-9") == select.Region("chr1:alt", 5, 9)
    assert select.parse_region("chr1:5-9xyz") == select.Region("chr1", 5, 9)
    for bad in ("chr1:1,000-2,000", "chr1:9-5", "chr1", ":1-2"):
        with pytest.raises(ValueError):
            select.parse_region(bad)


def test_closed_intervals(spark):
    df = spark.createDataFrame([("c", 1, 100), ("c", 201, 300), ("d", 1, 500)], "seqname string, start long, end long")
    assert [r["start"] for r in select.overlapping(df, "c:100-200").collect()] == [1]


def test_files(spark, tmp_path):
    rows = [GOOD.replace("exon", f) for f in ("gene", "exon", "exon")]
    (tmp_path / "a.gff").write_text("\n".join([rows[0], "##gff-version 3", "", rows[1], "bad\tline", "##FASTA", ">s", rows[2]]) + "\n")
    (tmp_path / "b.gtf").write_text("\n".join(rows) + "\n")
    lines = src.read_lines(spark, str(tmp_path))
    table = src.table_lines(lines)
    found = {r["path"].rsplit("/", 1)[1]: (r["format"], r["n"]) for r in rec.records(table).groupBy("path", "format").agg(F.count("*").alias("n")).collect()}
    assert found == {"a.gff": ("gff3", 2), "b.gtf": ("gtf", 3)}
    d = rec.diagnostics(table.where(F.col("path").endswith("a.gff"))).first()
    assert (d["parsed"], d["skipped"], d["errors"]) == (2, 2, 1)
    assert rec.records(lines).count() == 6  # without the cut, as statistics read files


def test_order_survives_splits(spark, tmp_path):
    n = 60_000
    (tmp_path / "x.gtf").write_text("".join(f"c\ts\texon\t{i}\t{i}\t.\t+\t.\tk\n" for i in range(n)))
    lines = src.read_lines(spark, str(tmp_path / "x.gtf"))
    assert lines.rdd.getNumPartitions() > 1
    write_records(rec.records(src.table_lines(lines)), str(tmp_path / "out"), src.ORDER)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert [int(x.split("\t")[3]) for x in text.splitlines()] == list(range(n))


def test_carriage_returns(spark, tmp_path):
    (tmp_path / "x.gtf").write_bytes((GOOD + "\r\n\r\n").encode())
    unix = rec.parse_lines(src.read_lines(spark, str(tmp_path / "x.gtf"))).orderBy("line_ord").collect()
    assert [r["line_kind"] for r in unix] == ["record", "error"] and unix[0]["attributes"].endswith("\r")
    assert rec.raw_records(src.read_lines(spark, str(tmp_path / "x.gtf"), "universal")).first()["gene_id"] == "LOC139519001"


def test_empty_table(spark):
    none = spark.createDataFrame([], "value string")
    assert tuple(rec.diagnostics(none).first()) == (0, 0, 0)
    assert rec.records(none).count() == 0 and rec.raw_records(none).count() == 0


def test_sorted_table_prunes(spark, tmp_path):
    from loomspan.sources.sinks import write_table

    df = spark.createDataFrame([(f"chr{i % 3}", i, i + 5) for i in range(500)], "seqname string, start long, end long")
    write_table(df, str(tmp_path / "t"))
    hits = select.overlapping(spark.read.parquet(str(tmp_path / "t")), "chr1:100-120")
    assert [r["start"] for r in hits.collect()] == [97, 100, 103, 106, 109, 112, 115, 118]
    plan = hits._jdf.queryExecution().toString()
    assert "EqualTo(seqname,chr1)" in plan and "LessThanOrEqual(start,120)" in plan


def test_six_digits(spark):
    """As C writes 32-bit floats, halves included."""
    import random
    import struct

    from loomspan.functions.numbers import six_digits

    random.seed(4)
    values = [0.0, -0.0, 1234565.0, 1234575.0, 999999.5, 1e-5, 1e-4, 0.00012345, 3.4e38, 1e-40, float("inf"), float("-inf"), float("nan")]
    values += [struct.unpack("f", struct.pack("I", random.getrandbits(32)))[0] for _ in range(2000)] + [random.randrange(10**7) / 8 for _ in range(2000)]
    values = [struct.unpack("f", struct.pack("f", v))[0] for v in values]
    got = spark.createDataFrame(list(enumerate(values)), "i int, x float").select("i", six_digits("x").alias("t")).collect()
    assert all(r["t"] == ("%g" % values[r["i"]]).replace("-nan", "nan") for r in got)


def test_hexadecimal_scores(spark):
    from loomspan.functions.numbers import leading_float

    cases = {"0x1p3": 8.0, "0x1.8": 1.5, "-0XA.Bp-2z": -2.671875, "0x": 0.0, "0xg": 0.0, "0x.8": 0.5, "1.5e3x": 1500.0}
    got = {r["v"]: r["f"] for r in spark.createDataFrame([(v,) for v in cases], "v string").select("v", leading_float(F.col("v")).alias("f")).collect()}
    assert got == cases
