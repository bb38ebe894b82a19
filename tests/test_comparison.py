import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspan import cli
from loomspan.operators import comparison, identifiers, select, statistics, transcripts
from loomspan.plans import reports
from loomspan.sources import records as rec

EXONS = "src int, seqname string, strand string, tx_id string, gene_id string, start long, end long"


def exons(spark, *sources, seqname="chr1", strand="+"):
    """Each source: {tx: [(start, end), ...]} or {(tx, seqname, strand): [...]}."""
    rows = []
    for s, txs in enumerate(sources, 1):
        for tx, ex in txs.items():
            name, seq, st = tx if isinstance(tx, tuple) else (tx, seqname, strand)
            rows += [(s, seq, st, name, name[0], a, b) for a, b in ex]
    return spark.createDataFrame(rows, EXONS)


def classes(spark, a, b):
    return {(r["src"], r["tx_id"]): r["cmp_class"] for r in comparison.classify(transcripts.assemble(exons(spark, a, b))).collect()}


THREE = [(1000, 1200), (1500, 1700), (2000, 2200)]


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        (THREE, {"B": THREE}, "="),
        (THREE, {"B": [(900, 1200), (1500, 1700), (2000, 2500)]}, "="),
        (THREE, {"B": [(1000, 1200), (1500, 2000), (2400, 2600)]}, "j"),
        (THREE[:2], {"B": THREE}, "j"),
        ([(1000, 2000)], {"B": [(1000, 2000)]}, "o"),
        (THREE[:2], {"B": [(1100, 1300), (1600, 1800)]}, "o"),
        ([(1000, 2000)], {("B", "chr1", "-"): [(1000, 2000)]}, "u"),
        ([(1000, 2000)], {("B", "chr1", "."): [(1000, 2000)]}, "u"),
        ([(1000, 2000)], {("B", "chr2", "+"): [(1000, 2000)]}, "u"),
        ([(1000, 2000)], {"B": [(2000, 3000)]}, "o"),
        ([(1000, 2000)], {"B": [(2001, 3000)]}, "u"),
        (THREE, {"B": [(1100, 1300)], "C": [(1000, 1200), (1500, 2000)], "D": THREE}, "="),
    ],
)
def test_classes(spark, a, b, want):
    assert classes(spark, {"A": a}, b)[1, "A"] == want


def test_self_comparison(spark):
    random.seed(2)
    txs = {f"t{i}": [(p, p + 50) for p in range(i * 40, i * 40 + random.choice([1, 300, 700]), 100)] for i in range(60)}
    got = classes(spark, txs, txs)
    assert all(c == ("=" if len(txs[t]) > 1 else "o") for (_, t), c in got.items())


def test_pairs_and_loci_equal_the_plain_definition(spark):
    random.seed(5)
    tx = []
    for i in range(400):
        s = random.randrange(0, 300_000)
        tx.append((random.choice([1, 2]), f"t{i}", random.choice(["a", "b"]), random.choice("+-"), s, s + random.choice([-5, 0, 10, 3000, 40_000, 10**9]), 0))
    df = spark.createDataFrame(tx, "src int, tx_id string, seqname string, strand string, start long, end long, n_introns int").repartition(3)
    want = {(x[1], y[1]) for x in tx for y in tx if x[0] == 1 and y[0] == 2 and x[2:4] == y[2:4] and x[4] <= y[5] and y[4] <= x[5]}
    got = [(r["a_tx_id"], r["b_tx_id"]) for r in comparison.overlapping_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    met = {(1, a) for a, _ in want} | {(2, b) for _, b in want}
    for width in (1000, 50_000, 1 << 20):
        found = [tuple(r) for r in comparison.with_partner(df, width).collect()]
        assert len(found) == len(met) and set(found) == met
    number, reach, last = {}, None, None
    for x in sorted(tx, key=lambda x: (x[2], x[3], x[4], x[5])):
        if x[2:4] != last:
            n, reach, last = 0, None, x[2:4]
        if reach is None or x[4] > reach:
            n += 1
        reach = x[5] if reach is None else max(reach, x[5])
        number[x[1]] = n
    for width in (1000, 50_000, 1 << 20):
        assert {r["tx_id"]: r["locus"] for r in transcripts.assign_locus(df, width).collect()} == number


def test_statistics(spark):
    rows = [(1, "c", "+", t, g, s, s + 10) for t, g, n in (("t1", "A", 3), ("t2", "A", 1), ("t3", "B", 1)) for s in range(0, n * 100, 100)]
    stats = statistics.exon_intron_stats(spark.createDataFrame(rows, EXONS))
    assert tuple(stats.first()) == (2, 3, 5, 2, 1, 2, 2.5, 1.0, 50.0, 100 * 2 / 3)
    assert "Single-exon transcripts : 2 (66.7%)" in reports.stats_report(stats)
    assert tuple(statistics.exon_intron_stats(spark.createDataFrame([], EXONS)).first()) == (0, 0, 0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0)


def test_transcripts_join_by_id_alone(spark):
    df = spark.createDataFrame([(1, "c2", "-", "t", "g2", 500, 600), (1, "c1", "+", "t", "g1", 100, 700), (1, "c1", "+", "t", "g1", 150, 160)], EXONS)
    r = transcripts.build_transcripts(df).first()
    assert (r["seqname"], r["strand"], r["gene_id"], r["start"], r["end"], r["n_exons"], r["n_introns"]) == ("c1", "+", "g1", 100, 700, 3, 2)
    for width in (60, 400, 1 << 17):
        assert sorted(tuple(i) for i in transcripts.introns_of(df, width).collect()) == [(1, "t", "c1", "+", 161, 499), (1, "t", "c1", "+", 701, 149)]


def random_exons(n, wild):
    """Transcripts with shared exons, repeated ones, and (wild) exons that end before they start."""
    random.seed(n)
    rows = []
    for i in range(n):
        at, tx = random.randrange(40) * 500, f"t{i}"
        for _ in range(random.choice([1, 1, 2, 3, 4])):
            end = at + random.choice([100, 200])
            rows.append((random.choice([1, 2]) if random.random() < 0.02 else i % 2 + 1, random.choice(["c1", "c1", "c2"]) if random.random() < 0.02 else "c1", "+", tx, "g", at, at - 300 if wild and random.random() < 0.1 else end))
            if random.random() < 0.03:
                rows.append(rows[-1])
            at = end + random.choice([0, 50, 300])
    return rows


def plain_classes(rows):
    """Every pair of transcripts, by the definition."""
    tx = {}
    for s, q, st, t, _, a, b in rows:
        tx.setdefault((s, t), []).append((a, b, q, st))
    own = {}
    for k, ex in tx.items():
        ex.sort()
        own[k] = (*ex[0][2:], ex[0][0], max(e[1] for e in ex), [(x[1] + 1, y[0] - 1) for x, y in zip(ex, ex[1:], strict=False)])
    out = {}
    for k, (q, st, a, b, ins) in own.items():
        rank = 0
        for m, (q2, st2, a2, b2, ins2) in own.items():
            if k[0] != m[0] and (q, st) == (q2, st2) and a <= b2 and a2 <= b:
                shared = len(set(ins) & set(ins2))
                rank = max(rank, 3 if ins and shared == len(ins) == len(ins2) else 2 if shared else 1)
        out[k] = "uoj="[rank]
    return out


@pytest.mark.parametrize("wild", [False, True])
def test_classes_equal_all_pairs(spark, wild):
    rows = random_exons(150, wild)
    both = transcripts.assemble(spark.createDataFrame(rows, EXONS).repartition(3))
    assert {(r["src"], r["tx_id"]): r["cmp_class"] for r in comparison.classify(both).collect()} == plain_classes(rows)
    pairs = comparison.with_shared(comparison.overlapping_pairs(both.tx), both.introns)
    ranks = {}
    for r in comparison.pair_class(pairs).collect():
        for k in ((1, r["a_tx_id"]), (2, r["b_tx_id"])):
            ranks[k] = max(ranks.get(k, 0), r["rank"])
    assert {k: "uoj="[ranks.get(k, 0)] for k in plain_classes(rows)} == plain_classes(rows)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_of_joins_read_little(spark):
    """Interval joins read each side once, carry no introns, and a class needs no join of intervals."""
    both = transcripts.assemble(exons(spark, {"A": THREE}, {"B": THREE}))
    pairs = plan(comparison.overlapping_pairs(both.tx))
    assert pairs.count("Scan parquet") == 2 and "intron" not in pairs.replace("n_introns", "")
    assert plan(transcripts.assign_locus(both.tx)).count("Scan parquet") == 2
    assert plan(comparison.with_partner(both.tx)).count("Scan parquet") <= 4 and "Join" not in plan(comparison.with_partner(both.tx))
    assert "collect_list" not in plan(transcripts.build_transcripts(both.tx.select("src", "tx_id", "seqname", "strand", "gene_id", "start", "end")))
    recs = both.tx.select("seqname", "start", "end")
    assert plan(select.overlapping_regions(recs, spark.range(3).selectExpr("id as region_id", "'chr1' as seqname", "id as start", "id + 5 as `end`"))).count("Scan parquet") == 1


def line(gene, tx, feature="exon", start=1, end=9):
    attributes = "; ".join(f'{k} "{v}"' for k, v in (("gene_id", gene), ("transcript_id", tx)) if v)
    return f"c\ts\t{feature}\t{start}\t{end}\t.\t+\t.\t{attributes or 'note x'};"


def test_ids(spark):
    rows = [(1, line("g1", "t1")), (1, line("g2", "t2")), (1, line(None, None)), (2, line("g2", "t2")), (2, line("g3", "t3")), (2, line(None, "t9"))]
    raw = rec.raw_records(spark.createDataFrame(rows, "src int, value string"))
    s = {r["level"]: r.asDict() for r in identifiers.summary(raw).collect()}
    assert [s["gene"][k] for k in ("n1", "n2", "shared", "only1", "only2")] == [2, 2, 1, 1, 1]
    assert sorted(str(r["gene_id"]) for r in identifiers.records_only_in(raw, 1).collect()) == ["None", "g1"]
    assert sorted(str(r["gene_id"]) for r in identifiers.merge(raw).collect()) == ["None", "None", "g1", "g2", "g3"]
    assert "N/A" not in reports.id_report(identifiers.summary(raw), "a", "b")
    assert "N/A" in reports.id_report(identifiers.summary(raw.where("src = 1")), "a", "b")


@pytest.fixture
def files(tmp_path):
    a = [line("A", "A1", start=s, end=s + 50) for s in (100, 300, 500)] + [line("B", "B1", "CDS", 900, 950), "# c"]
    b = [line("A", "A1", start=s, end=s + 50) for s in (100, 300, 500)] + [line("C", "C1", start=2000, end=2100), "broken\tline"]
    for name, rows in (("a.gtf", a), ("b.gtf", b)):
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    return str(tmp_path / "a.gtf"), str(tmp_path / "b.gtf")


def test_command_line(spark, files, capsys):
    a, b = files

    def run(*argv):
        code = cli.main(list(argv), spark)
        out = capsys.readouterr()
        return code, out.out.splitlines(), out.err

    code, out, err = run("print", a)
    assert code == 0 and len(out) == 4 and "parsed=4  skipped=1  errors=0  format=gtf" in err
    assert run("print", b)[0] == 1
    code, out, err = run("filter", "CDS", a)
    assert len(out) == 1 and "matched=1  total=4" in err
    assert run("attrs", "gene_id", a)[1] == ["A", "A", "A", "B"]
    code, out, err = run("overlap", "c:320-900", a)
    assert [x.split("\t")[3] for x in out] == ["300", "500", "900"] and "hits=3" in err
    assert run("overlap", "c:9-1", a)[0] == 1
    assert "Exons                   : 3" in run("stats", a)[1]
    out = "\n".join(run("compare", a, b)[1])
    assert "Exact match      (=)      :        1  (100.0%)" in out and "Sensitivity (GTF1 exact / GTF1 total) : 100.0%" in out
    code, out, err = run("ids", a, b, "--output", "merge")
    assert len(out) == 5 and "Wrote 5 records [merge]" in err and f"{b}:5: fewer than nine" in err
    assert run("ids", a, b, "--output", "none")[0] == 2
    for wrong in (("print",), ("nothing", a), ("print", a + "x"), ("compare", a, a + "x"), ()):
        code, out, err = run(*wrong)
        assert code == 1 and not out and "error" in err


def test_stream_equals_table(spark, files, tmp_path):
    from loomspan.streaming.records import feature_totals, stream_records

    q = feature_totals(stream_records(spark, str(tmp_path / "*.gtf"), files_per_trigger=1)).writeStream.outputMode("complete").format("memory").queryName("totals").start()
    q.processAllAvailable()
    q.stop()
    assert {r["feature"]: r["n"] for r in spark.table("totals").collect()} == {"exon": 7, "CDS": 1}


def test_wild_coordinates(spark):
    """One record far beyond all others neither fails nor loses a pair."""
    rows = [("c", 5, 10), ("c", 10**14, 10**14 + 5), ("c", -(10**9), 10**14 + 1), ("d", 1, 10**18), ("d", 10**17, 10**17)]
    regions = [(1, "c", 1, 7), (2, "c", 10**14 + 5, 10**15), (3, "d", 10**16, 10**18), (4, "e", 1, 10**18)]
    recs = spark.createDataFrame(rows, "seqname string, start long, end long")
    got = select.overlapping_regions(recs, spark.createDataFrame(regions, "region_id int, seqname string, start long, end long"))
    want = sorted((i, s, e) for i, q, a, b in regions for n, s, e in rows if n == q and s <= b and a <= e)
    assert sorted((r["region_id"], r["start"], r["end"]) for r in got.collect()) == want
    assert sorted((r["start"], r["rank"]) for r in select.position_rank(recs).where("seqname = 'c'").collect()) == [(-(10**9), 1), (5, 2), (10**14, 3)]


def test_many_exons_without_id(spark):
    n = 1_000_000
    exons = spark.range(n).selectExpr("1 as src", "'c' as seqname", "'+' as strand", "'' as tx_id", "'' as gene_id", "id * 10 as start", "id * 10 + 4 as `end`")
    r = transcripts.build_transcripts(exons).selectExpr("n_exons", "`end`").first()
    assert tuple(r) == (n, n * 10 - 6)
    gaps = transcripts.introns_of(exons)
    assert tuple(gaps.selectExpr("count(*)", "count_if(`end` - start = 4)", "max(start)").first()) == (n - 1, n - 1, n * 10 - 15)


def test_ranks_of_a_dense_stretch_are_balanced(spark):
    """One megabase with most of the records is many tasks, and ties go on counting."""
    recs = spark.range(200_000).selectExpr("if(id % 10 = 0, 'b', 'a') as seqname", "id % 1000 as start", "id % 1000 + 5 as `end`", "id as name").repartition(8)
    ranked = select.position_rank(recs, "name")
    assert ranked.count() == 200_000
    n = spark.conf.get("spark.sql.shuffle.partitions")
    held = [r["count"] for r in ranked.where("seqname = 'a'").groupBy((F.col("rank") / 10_000).cast("int")).count().collect()]
    assert max(held) <= 10_000 and int(n) > 1
    w = Window.partitionBy("seqname").orderBy("start", "end", "name")
    assert ranked.withColumn("want", F.row_number().over(w)).where("rank <> want").isEmpty()


def test_binned_table_reads_what_regions_name(spark, tmp_path):
    random.seed(1)
    rows = [(i, random.choice("ab"), s := random.randrange(10**8), s + random.choice([0, 5, 10**6, 3 * 10**7])) for i in range(500)] + [(900, "a", 10, 10**14), (901, "a", 50, 20), (902, "b", -(10**7), -5)]
    recs = spark.createDataFrame(rows, "id int, seqname string, start long, end long")
    select.write_binned(recs, str(tmp_path / "t"))
    regions = [(1, "a", 5 * 10**7, 5 * 10**7 + 100), (2, "b", 1, 10), (3, "a", -5, 10**15), (4, "z", 1, 2), (5, "b", 9, 4), (6, "b", -20, 0)]
    got = select.regions_of_binned(spark, str(tmp_path / "t"), "id int, start long, end long", spark.createDataFrame(regions, "region_id int, seqname string, start long, end long"))
    want = sorted((r, i) for r, q, a, b in regions for i, n, s, e in rows if a <= b and q == n and s <= b and a <= e)
    assert sorted((r["region_id"], r["id"]) for r in got.collect()) == want
    assert "dynamicpruning" in plan(got)
