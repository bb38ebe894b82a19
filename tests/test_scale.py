"""What keeps the work of large tables in proportion: lines are rendered and split once, numbers formatted once, large files are parts, bins hold many records."""

import os
import random

import __spark_entry__ as entry
from oracle import SMALL
from pyspark.sql import functions as F

from loomspan.functions import attributes as at
from loomspan.functions.numbers import leading_float, leading_int, leading_long, six_digits
from loomspan.operators import comparison, select, transcripts
from loomspan.sources import lines as src
from loomspan.sources import records as rec
from loomspan.sources import sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_rendered_and_split_once(spark):
    for name, texts in (("exons", 1), ("print_records", 2), ("filter_feature", 2)):  # the mixed lines have two forms
        p = plan(entry.queries()[name](spark, SMALL))
        assert (p.count("split(value"), p.count("concat_ws("), p.count("Exchange")) == (1, texts, 1), name
    p = plan(entry.queries()["exons"](spark, SMALL))
    assert "first(" not in p and "hashpartitioning(l_orderkey" in p


def test_numbers_are_formatted_once(spark):
    assert plan(spark.range(3).select(six_digits(F.col("id").cast("float")).alias("t"))).count("format_string") == 2


def test_short_ways_of_numbers_equal_the_lenient_ones(spark):
    texts = ["12", "-12", "+12", "012", "-0", " 7", "7 ", "\x017", "1.5", "1.50x", "5.", ".5", "-3.25", "1d", "1e3", "NaN", "Infinity", "12\n", "12\r", "", "-", "x", "9223372036854775807", "9223372036854775808", "2147483648", "-2147483649", "1" * 400]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    # With a letter behind it no text is a number as a whole, and what leads it stays the same.
    t, long = F.col("t"), F.concat("t", F.lit("z"))
    odd = df.where(~((leading_long(t) == leading_long(long)) & (leading_int(t) == leading_int(long)) & (leading_float(t).eqNullSafe(leading_float(long)))))
    assert [r["t"] for r in odd.collect()] == []


def test_ids_equal_the_plain_readings(spark):
    random.seed(3)
    parts = ["gene_id", "gene_id ", ' "', '"', ";", " ", "\t", "a", "é", "_", "-", 'gene_id "x"', "gene_id y;", 'gene_id ""']
    df = spark.createDataFrame([("".join(random.choice(parts) for _ in range(random.randrange(9))),) for _ in range(4000)], "a string")
    a = F.col("a")
    old = r'(?:^|;)[ \t]*gene_id[ \t]+(?:"([^"]*)|([^; \t]*))'
    bare = lambda p: F.nullif(F.regexp_extract(a, p, 1), F.lit(""))
    token = F.concat(F.regexp_extract(a, old, 1), F.regexp_extract(a, old, 2))
    word = F.coalesce(bare(r'(?U)\bgene_id "([^"]+)"'), bare(r"(?U)\bgene_id (\S+?)(?:;|$)"))
    same = at.token_id(a, "gene_id").eqNullSafe(token) & at.word_id(a, "gene_id").eqNullSafe(word) & at.gtf_value(a, "gene_id").eqNullSafe(at.lookup(at.gtf_attributes(a), "gene_id"))
    assert [r["a"] for r in df.where(~same).collect()] == []


def test_parts_of_a_folder_are_one_file(spark, tmp_path):
    row = "c\ts\texon\t{}\t9\t.\t+\t.\tk"
    parts = [["# c", row.format(1)], [row.format(2), "##gff-version 3"], ["bad", row.format(3), "##FASTA"], [row.format(4), "bad"]]
    for seq in "ab":
        (tmp_path / "f" / f"seq={seq}").mkdir(parents=True)
        for i, lines in enumerate(parts):
            (tmp_path / "f" / f"seq={seq}" / f"part-{99998 + i:05d}-x.txt").write_text("\n".join(lines) + "\n")
    lines = src.read_lines(spark, str(tmp_path / "f"), folders=True)
    got = sorted((r["path"][-6:], r["format"], r["start"]) for r in rec.records(src.table_lines(lines)).collect())
    assert got == [(f"seq={s}/", "gff3", i) for s in "ab" for i in (1, 2, 3)]
    bad = sorted((r["path"][-6:], r["line_no"]) for r in rec.malformed(src.numbered(lines)).collect())
    assert bad == [(f"seq={s}/", n) for s in "ab" for n in (5, 9)]


def test_bins_hold_many_records(spark, tmp_path):
    recs = spark.range(2000).selectExpr("'c' as seqname", "id * 500000 as start", "id * 500000 + 9 as `end`")
    select.write_binned(recs, str(tmp_path / "t"))
    assert len(os.listdir(tmp_path / "t" / "seqname=c" / "level=0")) <= 16


def test_parts_of_transcripts_meet(spark):
    """Transcripts over many bins, parts of one on another sequence or strand, repeated exons: introns and transcripts as by the plain definition, and chains are told apart whatever the bins."""
    random.seed(5)
    rows = []
    for i in range(60):
        s, at = i % 2 + 1, random.randrange(20) * 100
        for _ in range(random.choice([1, 2, 5])):
            rows.append((s, random.choice(["c1", "c1", "c1", "c2"]), random.choice("++-"), f"t{i // 2}" if i % 3 else "", "g", at, at + random.choice([50, 400])))
            rows += rows[-1:] if random.random() < 0.2 else []
            at += random.choice([0, 100, 700])
    exons = spark.createDataFrame(rows, "src int, seqname string, strand string, tx_id string, gene_id string, start long, end long").repartition(3)
    got = [transcripts.assemble(exons, width) for width in (64, 500, 1 << 17)]
    plain = sorted(tuple(r) for r in transcripts.build_transcripts(exons).collect())
    gaps = sorted(tuple(r) for r in transcripts.introns_of(exons).collect())
    chains = [sorted(tuple(r) for r in a.tx.select("src", "tx_id", "chain_x", "chain_y").collect()) for a in got]
    for a in got:
        assert sorted(tuple(r)[:10] for r in a.tx.collect()) == plain and sorted(tuple(r) for r in a.gaps.collect()) == gaps
    assert chains[0] == chains[1] == chains[2]


def test_classes_and_loci_shuffle_each_transcript_few_times(spark):
    """One order by place gives loci and partners; nothing sorts for an aggregate, nor meets introns by a join of their own."""
    both = transcripts.assemble(spark.createDataFrame([(1, "c", "+", "t", "g", 1, 9), (2, "c", "+", "u", "g", 1, 9)], "src int, seqname string, strand string, tx_id string, gene_id string, start long, end long"))
    p = plan(comparison.classify(both)).split("Initial Plan")[-1]
    assert p.count("Exchange") <= 8 and "SortAggregate" not in p and p.count("Join") == 1
    located = comparison.classify(both, loci=True)
    assert plan(located).count("Join") == 1 and {(r["tx_id"], r["locus"], r["cmp_class"]) for r in located.collect()} == {("t", 1, "o"), ("u", 1, "o")}


def test_lines_are_parsed_once_for_ranges(spark, tmp_path):
    """What is ranged is stored before, as Spark runs it twice."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    recs = spark.range(100).select(F.lit("c").alias("seqname"), counted(F.col("id")).alias("start"), (F.col("id") + 5).alias("end"))
    sinks.write_table(recs, str(tmp_path / "t"))
    assert seen.value == 100
    assert select.position_rank(recs).count() == 100 and seen.value == 200
    written = entry.queries()["sink_written_counts"](spark, SMALL)
    assert {r["output"] for r in written.collect()} == {"merge", "only-in-1", "only-in-2"}


def test_repeated_rows_need_no_hash_table(spark):
    """Rows are told apart in the order that keeps the lines of a transcript together."""
    p = plan(entry.queries()["exons"](spark, SMALL))
    assert "HashAggregate" not in p and p.count("Sort [") == 1
