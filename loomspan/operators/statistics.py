"""Exon and intron statistics of one annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import percent, ratio


def transcript_exons(exons: DataFrame, *by: str) -> DataFrame:
    """by..., tx_id, gene_id (the least, should there be several), exon_count."""
    return exons.groupBy(*by, "tx_id").agg(F.min("gene_id").alias("gene_id"), F.count("*").alias("exon_count"))


def gene_rollup(exons: DataFrame, *by: str) -> DataFrame:
    """by..., gene_id, n_transcripts, n_exons, single_exon (all its transcripts have one exon)."""
    return transcript_exons(exons, *by).groupBy(*by, "gene_id").agg(F.count("*").alias("n_transcripts"), F.sum("exon_count").alias("n_exons"), (F.max("exon_count") == 1).alias("single_exon"), F.count_if(F.col("exon_count") == 1).alias("n_single"))


def exon_intron_stats(exons: DataFrame, *by: str) -> DataFrame:
    """One row, all zeros without exons; with `by` a row for each of its values. Genes carry the sums of their transcripts, so one chain of aggregates gives all ten figures."""
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    sums = gene_rollup(exons, *by).groupBy(*by).agg(
        F.count("*").alias("n_genes"),
        zero(F.sum("n_transcripts")).alias("n_transcripts"),
        zero(F.sum("n_exons")).alias("n_exons"),
        zero(F.sum(F.col("n_exons") - F.col("n_transcripts"))).alias("n_introns"),
        F.count_if("single_exon").alias("n_single_exon_genes"),
        zero(F.sum("n_single")).alias("n_single_exon_transcripts"),
    )
    c = F.col
    return sums.withColumns(
        {
            "mean_exons_per_gene": ratio(c("n_exons"), c("n_genes")),
            "mean_introns_per_gene": ratio(c("n_introns"), c("n_genes")),
            "pct_single_exon_genes": percent(c("n_single_exon_genes"), c("n_genes")),
            "pct_single_exon_transcripts": percent(c("n_single_exon_transcripts"), c("n_transcripts")),
        }
    )
