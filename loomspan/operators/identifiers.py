"""Comparison of two annotations (src 1 and 2) by gene and transcript ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ids(raw: DataFrame, level: str) -> DataFrame:
    """src, id: the distinct non-null ids of a level (gene_id or transcript_id) over all features."""
    return raw.select("src", F.col(level).alias("id")).where("id is not null").distinct()


def presence(raw: DataFrame, level: str) -> DataFrame:
    """id, in_1, in_2."""
    return raw.where(F.col(level).isNotNull()).groupBy(F.col(level).alias("id")).agg(F.bool_or(F.col("src") == 1).alias("in_1"), F.bool_or(F.col("src") == 2).alias("in_2"))


def shared_ids(raw: DataFrame, level: str) -> DataFrame:
    return presence(raw, level).where("in_1 and in_2").select("id")


def ids_only_in(raw: DataFrame, level: str, src: int) -> DataFrame:
    return presence(raw, level).where(f"in_{src} and not in_{3 - src}").select("id")


def summary(raw: DataFrame) -> DataFrame:
    """level, n1, n2, shared, only1, only2 for genes and transcripts; the Venn regions are the last three."""
    def one(level: str, name: str) -> DataFrame:
        c = lambda cond, alias: F.count_if(F.expr(cond)).alias(alias)
        return presence(raw, level).agg(c("in_1", "n1"), c("in_2", "n2"), c("in_1 and in_2", "shared"), c("in_1 and not in_2", "only1"), c("in_2 and not in_1", "only2")).select(F.lit(name).alias("level"), "n1", "n2", "shared", "only1", "only2")

    return one("gene_id", "gene").unionByName(one("transcript_id", "transcript"))


def records_only_in(raw: DataFrame, src: int) -> DataFrame:
    """Records of src whose gene is absent from the other annotation; records without a gene are kept."""
    other = raw.where((F.col("src") == 3 - src) & F.col("gene_id").isNotNull()).select("gene_id").distinct()
    return raw.where(F.col("src") == src).join(other, "gene_id", "left_anti").select(*raw.columns)


def merge(raw: DataFrame) -> DataFrame:
    """All records of src 1 and those of src 2 whose gene src 1 lacks; duplicates stay."""
    return raw.where("src = 1").unionByName(records_only_in(raw, 2))
