"""Registered queries that go through files: annotation files are written from `lineitem` to the shared folder, one for each source and sequence, and read again;
sinks are read back; reports come out line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from ..operators import comparison, identifiers, select, statistics, transcripts
from ..sources import lines as src
from ..sources import records as rec
from ..sources import sinks
from ..sources.workspace import drop, own_path, store
from . import fixture, reports
from .queries import _EXONS, _IDS, _PAIRS, _RECORD, _SUM, _TX, ORACLES, REGION, _assembly, _exon_records, _exons, _raw, query

LAST_SLOT = 5  #: exons of later slots stand after the sequence section


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the files, as the scan gives them, with src and seqname from the path. A file is a folder of parts, ranged by place, so that no task sorts and writes a whole sequence."""
    path = own_path(spark, "files")
    exons = rec.records(fixture.exon_lines(spark, sf_dir).withColumn("line", F.col("value")))
    slot = F.regexp_extract("attributes", "exon_number ([0-9]+)", 1).cast("int")
    body = store(exons.select("src", "seqname", F.when(slot <= LAST_SLOT, 3).otherwise(5).alias("place"), "start", F.col("line").alias("value")), "body")
    head = body.select("src", "seqname").distinct()
    name = F.col("seqname")
    pragma = F.when(name.isin("chr1", "chr3"), F.lit("##gff-version 3"))
    lines = F.array(F.concat(F.lit("# "), name), pragma, F.concat(name, F.lit("\tbroken")), F.lit("##FASTA"), F.concat(F.lit(">"), name), F.lit("ACGT"))
    places = F.array(*[F.lit(p) for p in (0, 1, 2, 4, 4, 4)])
    extra = head.select("src", "seqname", F.posexplode(F.arrays_zip(places.alias("place"), lines.alias("value"))).alias("start", "x")).select("src", "seqname", "x.place", F.col("start").cast("long").alias("start"), "x.value").where("value is not null")
    body.unionByName(extra).orderBy("src", "seqname", "place", "start").select("src", "seqname", "value").write.partitionBy("src", "seqname").text(path)
    drop(body)
    return _named(src.read_lines(spark, path, folders=True))


def _named(lines: DataFrame) -> DataFrame:
    part = lambda key: F.regexp_extract("path", f"/{key}=([^/]+)/", 1)
    return lines.withColumns({"src": part("src").cast("int"), "file_seqname": part("seqname")})


_FILES = f"""{_EXONS}, line AS (SELECT src, seqname, slot, start, tx_id, gene_id, strand, "end", seqname || chr(9) || 'src' || src || chr(9) || 'exon' || chr(9) || start || chr(9) || "end" || chr(9) || '.' || chr(9) || strand || chr(9) || '.' || chr(9) || 'gene_id "' || gene_id || '"; transcript_id "' || tx_id || '"; exon_number ' || slot || ';' AS value FROM ex),
file AS (SELECT src, seqname, count(*) AS n, count(*) FILTER (slot <= {LAST_SLOT}) AS n_before, sum(length(value)) AS chars, CASE WHEN seqname IN ('chr1', 'chr3') THEN 'gff3' ELSE 'gtf' END AS format FROM line GROUP BY src, seqname)"""


@query(f"WITH {_FILES} SELECT src, seqname, n + 5 + CAST(format = 'gff3' AS INT) AS n_lines, CAST(chars + 3 * length(seqname) + 21 + CASE format WHEN 'gff3' THEN 15 ELSE 0 END AS BIGINT) AS n_chars FROM file")
def file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).groupBy("src", F.col("file_seqname").alias("seqname")).agg(F.count("*").alias("n_lines"), F.sum(F.length("value")).alias("n_chars"))


@query(f"WITH {_FILES} SELECT src, seqname, format, n_before AS n_records FROM file")
def file_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.records(src.table_lines(_files(spark, sf_dir)).drop("line_ord")).groupBy("src", "seqname", "format").agg(F.count("*").alias("n_records"))


@query(f"WITH {_FILES} SELECT src, seqname, start, \"end\", strand FROM line WHERE slot <= {LAST_SLOT}")
def file_table_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.records(src.table_lines(_files(spark, sf_dir))).select("src", "seqname", "start", "end", "strand")


@query(ORACLES["exon_intron_stats"])
def file_exon_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics read whole files, also what stands after the sequence section."""
    return statistics.exon_intron_stats(transcripts.exons_of(rec.records(_files(spark, sf_dir)), "src"), "src")


@query(f"""WITH {_FILES}, h AS (SELECT *, 1 + CAST(format = 'gff3' AS INT) AS head FROM file)
 SELECT src, seqname, head + 1 AS line_no FROM h UNION ALL SELECT src, seqname, head + 1 + n_before + 2 FROM h UNION ALL SELECT src, seqname, head + 1 + n_before + 3 FROM h""")
def file_malformed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.malformed(src.numbered(_files(spark, sf_dir))).select("src", F.col("file_seqname").alias("seqname"), "line_no")


@query(f"WITH {_EXONS} SELECT DISTINCT src, gene_id AS id FROM ex")
def file_carriage_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of files whose lines end in a carriage return and a line feed."""
    path = own_path(spark, "crlf")
    fixture.exon_lines(spark, sf_dir).select("src", F.concat("value", F.lit("\r")).alias("value")).write.partitionBy("src").text(path)
    return identifiers.ids(rec.raw_records(_named(src.read_lines(spark, path, "universal"))), "gene_id")


def _back(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value")


@query(f"WITH {_IDS} SELECT value FROM (SELECT {_RECORD} FROM ex)")
def sink_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = own_path(spark, "records")
    sinks.write_records(_exon_records(spark, sf_dir), path, select.POSITION)
    return _back(spark, path)


@query(f"WITH {_IDS} SELECT value FROM (SELECT {_RECORD} FROM ex WHERE src = 1 AND gene_id NOT IN (SELECT id FROM genes WHERE in_2))")
def sink_raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = own_path(spark, "raw")
    sinks.write_lines(identifiers.records_only_in(_raw(spark, sf_dir), 1), path, ("src", "value"))
    return _back(spark, path)


@query(f"WITH {_EXONS} SELECT tx_id AS value FROM ex")
def sink_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One attribute value a line."""
    path = own_path(spark, "scalars")
    sinks.write_lines(select.attribute(_exon_records(spark, sf_dir), "transcript_id", F.lit("gtf")), path, select.POSITION)
    return _back(spark, path)


@query(f"""WITH {_IDS} SELECT 'merge' AS output, count(*) AS n FROM ex WHERE src = 1 OR gene_id NOT IN (SELECT id FROM genes WHERE in_1)
 UNION ALL SELECT 'only-in-1', count(*) FROM ex WHERE src = 1 AND gene_id NOT IN (SELECT id FROM genes WHERE in_2) UNION ALL SELECT 'only-in-2', count(*) FROM ex WHERE src = 2 AND gene_id NOT IN (SELECT id FROM genes WHERE in_1)""")
def sink_written_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted as the rows are written. Every output reads the records several times (genes of both sources, bounds of the ranges), so they are stored: lines are read once."""
    raw = store(_raw(spark, sf_dir).select("src", "gene_id", "value"), "raw")
    kept = {"merge": identifiers.merge(raw), "only-in-1": identifiers.records_only_in(raw, 1), "only-in-2": identifiers.records_only_in(raw, 2)}
    return spark.createDataFrame([(k, sinks.write_lines(d, own_path(spark, "written"), ("src", "value"))) for k, d in kept.items()], "output string, n long")


@query(ORACLES["overlap_region"])
def sorted_table_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region of a table that is ranged and sorted by position: files and row groups outside it are not read."""
    path = own_path(spark, "sorted")
    sinks.write_table(_exon_records(spark, sf_dir), path)
    return select.overlapping(spark.read.parquet(path), REGION).select("src", "seqname", "start", "end", "strand")


def _rows(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text.splitlines(), 1)), "line_no int, line string")


_STATS = ORACLES["exon_intron_stats"]


@query(f"""WITH s AS ({_STATS}) SELECT CAST(line_no AS INT) AS line_no, line FROM (SELECT unnest(range(1, 9)) AS line_no, unnest([
 'Genes                   : ' || n_genes, 'Transcripts             : ' || n_transcripts, 'Exons                   : ' || n_exons, 'Introns                 : ' || n_introns,
 printf('Mean exons per gene     : %.2f', mean_exons_per_gene), printf('Mean introns per gene   : %.2f', mean_introns_per_gene),
 printf('Single-exon genes       : %d (%.1f%%)', n_single_exon_genes, pct_single_exon_genes), printf('Single-exon transcripts : %d (%.1f%%)', n_single_exon_transcripts, pct_single_exon_transcripts)]) AS line FROM s WHERE src = 1)""")
def report_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, reports.stats_report(statistics.exon_intron_stats(_exons(spark, sf_dir).where("src = 1"))))


def _block(s: int) -> str:
    share = lambda name, c: f"printf('  {name:<26}: %8d  (%5.1f%%)', {c}, 100.0::DOUBLE * {c} / n_tx)"
    return f"""SELECT unnest(range({5 + 7 * (s - 1)}, {12 + 7 * (s - 1)})) AS line_no, unnest(['=== Transcript classification (GTF{s}) ===', printf('  {f"GTF{s}":<26}: %8d', n_tx),
 {share("Exact match      (=)", "n_exact")}, {share("Partial match    (j)", "n_partial")}, {share("Overlap only     (o)", "n_overlap")}, {share("Unique           (u)", "n_unique")}, '']) AS line FROM counts WHERE src = {s}"""


@query(f"""WITH {_PAIRS}, d AS (SELECT seqname, strand, start, "end", max(CAST(src = 1 AS INT)) AS one, max(CAST(src = 2 AS INT)) AS two FROM intr GROUP BY ALL),
 s AS (SELECT count(*) FILTER (one = 1) AS i1, count(*) FILTER (two = 1) AS i2, count(*) FILTER (one = 1 AND two = 1) AS i FROM d)
 SELECT CAST(line_no AS INT) AS line_no, line FROM (
 SELECT unnest(range(1, 5)) AS line_no, unnest(['Structural GTF comparison', '  GTF1 = one.gtf', '  GTF2 = two.gtf', '']) AS line UNION ALL {_block(1)} UNION ALL {_block(2)}
 UNION ALL SELECT unnest(range(19, 24)), unnest(['=== Intron-level ===', printf('  {"GTF1 unique introns":<26}: %8d', i1), printf('  {"GTF2 unique introns":<26}: %8d', i2),
  printf('  {"Shared":<26}: %8d  (%.1f%% of GTF1, %.1f%% of GTF2)', i, 100.0::DOUBLE * i / i1, 100.0::DOUBLE * i / i2), '']) FROM s
 UNION ALL SELECT 24, printf('  Sensitivity (GTF1 exact / GTF1 total) : %.1f%%', 100.0::DOUBLE * n_exact / n_tx) FROM counts WHERE src = 1
 UNION ALL SELECT 25, printf('  Precision   (GTF2 exact / GTF2 total) : %.1f%%', 100.0::DOUBLE * n_exact / n_tx) FROM counts WHERE src = 2)""")
def report_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _assembly(spark, sf_dir)
    return _rows(spark, reports.compare_report(comparison.class_counts(comparison.classify(both)), comparison.intron_counts(both.gaps), "one.gtf", "two.gtf"))


def _id_block(level: str, title: str, at: int) -> str:
    row = lambda name, c: f"printf('  {name:<22}: %10s', format('{{:,}}', {c}))"
    share = lambda c, n, g: f"printf('%.1f%%', 100.0::DOUBLE * {c} / {n}) || ' of GTF{g}'"
    return f"""SELECT unnest(range({at}, {at + 7})) AS line_no, unnest(['', '=== {title} comparison ===', {row("GTF1", "n1")}, {row("GTF2", "n2")},
 {row("Shared", "shared")} || '  (' || {share("shared", "n1", 1)} || ', ' || {share("shared", "n2", 2)} || ')', {row("Only in GTF1", "only1")} || '  (' || {share("only1", "n1", 1)} || ')', {row("Only in GTF2", "only2")} || '  (' || {share("only2", "n2", 2)} || ')']) AS line FROM s WHERE level = '{level}'"""


@query(f"""{_SUM} SELECT CAST(line_no AS INT) AS line_no, line FROM (SELECT 1 AS line_no, '  GTF1 = one.gtf' AS line UNION ALL SELECT 2, '  GTF2 = two.gtf'
 UNION ALL {_id_block("gene", "Gene-level", 3)} UNION ALL {_id_block("transcript", "Transcript-level", 10)})""")
def report_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the labels that stand where none are given."""
    return _rows(spark, reports.id_report(identifiers.summary(_raw(spark, sf_dir)), cli.label_of(None, "/some/where/one.gtf"), cli.label_of("two.gtf", "other.gtf")))


@query(f"{_SUM} SELECT level, only1, only2, shared FROM s")
def report_venn_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = reports.venn_sizes(identifiers.summary(_raw(spark, sf_dir)))
    return spark.createDataFrame([(level, *regions) for level, regions in sizes.items()], "level string, only1 long, only2 long, shared long")


#: Records far beyond all others, and exons without an id.
@query(f"""WITH {_TX}, all_tx AS (SELECT src, tx_id, seqname, strand, start, "end" FROM tx UNION ALL SELECT 2, 'wild', 'chr1', '+', 100, 100000000000000 UNION ALL SELECT 1, 'far', 'chr1', '+', 99999999999000, 99999999999500)
 SELECT a.tx_id AS a_tx_id, b.tx_id AS b_tx_id FROM all_tx a JOIN all_tx b ON a.src = 1 AND b.src = 2 AND a.seqname = b.seqname AND a.strand = b.strand AND a.start <= b."end" AND b.start <= a."end" """)
def wild_interval_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    wild = spark.createDataFrame([(2, "chr1", "+", "wild", "w", 100, 10**14), (1, "chr1", "+", "far", "f", 10**14 - 1000, 10**14 - 500)], "src int, seqname string, strand string, tx_id string, gene_id string, start long, end long")
    return comparison.overlapping_pairs(store(transcripts.build_transcripts(_exons(spark, sf_dir).unionByName(wild)), "transcripts")).select("a_tx_id", "b_tx_id")


@query(f"WITH {_EXONS} SELECT src, '' AS tx_id, min(start) AS start, max(\"end\") AS \"end\", CAST(count(*) AS INT) AS n_exons, CAST(count(*) - 1 AS INT) AS n_introns FROM ex GROUP BY src")
def exons_without_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exons that name no transcript are one transcript."""
    return transcripts.build_transcripts(_exons(spark, sf_dir).withColumn("tx_id", F.lit(""))).select("src", "tx_id", "start", "end", "n_exons", "n_introns")
