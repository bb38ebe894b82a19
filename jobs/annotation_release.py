"""Job 1: the comparison of two annotation releases, transcript by transcript.

    python -m jobs.annotation_release --config jobs/annotation_release.json [--first FILES --second FILES | --input FOLDER] [--output FOLDER]

Someone who moves from one release of an annotation to the next wants to know, for each transcript, whether the other release has it too, and in which locus it lies. The job reads the lines of
two annotations (GTF or GFF3 files, or the lines that `lineitem` is rendered to), assembles transcripts, numbers loci, classifies each transcript against the other release, and writes
Parquet partitioned by release (src) and sequence.

Run again, it writes the same: a run over all sequences replaces the table, a run over some (`sequences`) replaces just their partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, command_line, counted, session, settings
from loomspan.operators import comparison, transcripts
from loomspan.plans import fixture
from loomspan.plans.queries import _LOCI, _PAIRS
from loomspan.sources import records
from loomspan.sources.lines import read_lines
from loomspan.sources.workspace import new_path

PARTITIONS = ("src", "seqname")
SCHEMA = "tx_id string, gene_id string, strand string, start long, end long, n_exons int, n_introns int, locus long, cmp_class string, src int, seqname string"


def lines_of_files(spark: SparkSession, first: str, second: str) -> DataFrame:
    """src, value: the lines of two annotations, whole files, as the structural comparison reads them."""
    one = lambda path, s: read_lines(spark, path).select(F.lit(s).alias("src"), "value")
    return one(first, 1).unionByName(one(second, 2))


def compare(spark: SparkSession, lines: DataFrame, output: str, sequences: list[str] | None = None) -> DataFrame:
    """Writes the transcripts of the releases in lines (src, value) to `output`; the table read back."""
    watched, read = counted(lines)
    recs = records.records(watched)
    if sequences:
        recs = recs.where(F.col("seqname").isin(*sequences))
    # One table serves loci and classes, so the lines are read and assembled once.
    both = transcripts.assemble(transcripts.exons_of(recs, "src"))
    # Where no exon is left Spark drops the plan, and what was observed in it.
    empty = both.tx.isEmpty()
    LOG.info("read %d lines of two releases", lines.count() if empty else read.get["n"])
    result = comparison.classify(both, loci=True).select("tx_id", "gene_id", "strand", "start", "end", "n_exons", "n_introns", "locus", "cmp_class", *PARTITIONS)
    rows, written = counted(result)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if sequences else "static").partitionBy(*PARTITIONS).parquet(output)
    both.drop()
    LOG.info("wrote %s: %d transcripts of %s", output, 0 if empty else written.get["n"], ", ".join(sequences) if sequences else "all sequences")
    table = spark.read.schema(SCHEMA).parquet(output)
    for r in comparison.class_counts(table).orderBy("src").collect():
        LOG.info("release %d: %d transcripts, %d exact, %d partial, %d overlap only, %d unique", *r)
    return table


def run(spark: SparkSession, folder: str, output: str, sequences: list[str] | None = None) -> DataFrame:
    """The comparison of the two annotations that folder/lineitem.parquet stands for."""
    return compare(spark, fixture.exon_lines(spark, folder), output, sequences)


ORACLE = f"""{_LOCI},
{_PAIRS.partition("intr AS (")[2].partition(",\n")[2]}
SELECT c.src, c.tx_id, c.seqname, c.strand, c.gene_id, c.start, c."end", c.n_exons, c.n_introns, l.locus, c.cmp_class FROM cls c JOIN l USING (src, tx_id)"""


def job1_annotation_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job, twice into one new folder, and its output after that."""
    output = new_path(spark, "job1")
    run(spark, sf_dir, output)
    return run(spark, sf_dir, output)


def main() -> None:
    given = command_line(__doc__.splitlines()[0], "input", "first", "second", "output")
    spark = session("annotation_release")
    try:
        s = settings(spark, given)
        lines = lines_of_files(spark, str(s["first"]), str(s["second"])) if s.get("first") and s.get("second") else fixture.exon_lines(spark, str(s["input"]))
        compare(spark, lines, str(s["output"]), list(s.get("sequences") or []))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
