"""Lines to records: nine tab-separated columns, read leniently, by column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.attributes import attributes_of, once, word_id
from ..functions.numbers import leading_float, leading_int, leading_long

COLUMNS = ("seqname", "source", "feature", "start", "end", "score", "strand", "frame", "attributes")


def line_kind(value: Column, tokens: Column) -> Column:
    """'skipped' (empty, or # first), 'record' (nine tokens or more), else 'error'."""
    return F.when((value == "") | F.startswith(value, F.lit("#")), "skipped").when(F.size(tokens) >= 9, "record").otherwise("error")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Any frame with `value` -> its columns, `line_kind`, and the nine record columns (null where the line is no record).

    Runs of tabs count as one, tokens after the ninth are dropped. start and end: leading integer, else 0. score: null if it starts with a point.
    strand: first character. frame: null if it starts with a point or is -1."""
    own = lines.withColumn("tokens", once(F.array_remove(F.split("value", "\t"), ""))).withColumn("line_kind", line_kind(F.col("value"), F.col("tokens")))
    t = lambda i: F.when(F.col("line_kind") == "record", F.get("tokens", F.lit(i)))
    missing = lambda i: F.startswith(t(i), F.lit("."))
    frame = leading_int(t(7))
    held = lambda c, i: F.when(t(i).isNotNull(), c)
    return own.select(
        *lines.columns,
        "line_kind",
        t(0).alias("seqname"),
        t(1).alias("source"),
        t(2).alias("feature"),
        held(leading_long(t(3)), 3).alias("start"),
        held(leading_long(t(4)), 4).alias("end"),
        F.when(~missing(5), leading_float(t(5))).alias("score"),
        F.substring(t(6), 1, 1).alias("strand"),
        F.when(~missing(7) & (frame != -1), frame).alias("frame"),
        t(8).alias("attributes"),
    )


def records(lines: DataFrame) -> DataFrame:
    """The records alone."""
    return parse_lines(lines).where("line_kind = 'record'").drop("line_kind", "value")


def diagnostics(lines: DataFrame) -> DataFrame:
    """One row: parsed, skipped, errors."""
    count = lambda kind, name: F.count_if(F.col("line_kind") == kind).alias(name)
    return parse_lines(lines).agg(count("record", "parsed"), count("skipped", "skipped"), count("error", "errors"))


def with_pairs(recs: DataFrame, fmt: Column | None = None) -> DataFrame:
    """records with `pairs`, the attribute list in the grammar of `format` (or of fmt)."""
    return recs.withColumn("pairs", attributes_of(F.col("attributes"), fmt if fmt is not None else F.col("format")))


def raw_records(lines: DataFrame) -> DataFrame:
    """Lines as the identifier comparison reads them: empty fields count; fewer than nine fields is no record. Adds gene_id and transcript_id (null if absent)."""
    fields = F.split("value", "\t")
    kept = lines.where((F.col("value") != "") & ~F.startswith("value", F.lit("#")) & (F.size(fields) >= 9))
    ninth = F.get(fields, F.lit(8))
    return kept.withColumns({"gene_id": word_id(ninth, "gene_id"), "transcript_id": word_id(ninth, "transcript_id")})


def malformed(lines: DataFrame) -> DataFrame:
    """Lines that raw_records leaves out with a warning."""
    return lines.where((F.col("value") != "") & ~F.startswith("value", F.lit("#")) & (F.size(F.split("value", "\t")) < 9))
