"""Whole texts in a table, each read as a file of annotation lines. A text is one row, so its order, sequence section and format need no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What begins the sequence section and the format pragma; nine tab-separated fields, empty ones left out or counted.
SECTION, PRAGMA = "##FASTA", "##gff-version"
NINE_TOKENS = r"^\t*+(?:[^\t]++\t++){8}[^\t]"
NINE_FIELDS = r"^(?:[^\t]*+\t){8}"
THIRD_TOKEN = r"^\t*+(?:[^\t]++\t++){2}([^\t]++)"


def lines_of(text: Column, newline: str = "unix") -> Column:
    """The lines of a text. 'unix' splits at line feeds only, 'universal' also at carriage returns; what follows the last break is a line if it is not empty. Null: none."""
    parts = F.split(F.coalesce(text, F.lit("")), "\n" if newline == "unix" else "\r\n|\r|\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def _starts(line: Column, *heads: str) -> Column:
    out = F.lit(False)
    for h in heads:
        out = out | F.startswith(line, F.lit(h))
    return out


def _skipped(line: Column) -> Column:
    return (line == "") | _starts(line, "#")


def _count(lines: Column, test) -> Column:  # noqa: ANN001
    return F.size(F.filter(lines, test)).cast("long")


def digest(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts' columns without `text`, and for each text:

    n_lines; cut_line, the line of the sequence section (null without one); format ('gff3' if a pragma stands before it, else 'gtf'); n_skipped, n_records, n_errors and
    first_error (a line number, null without errors) before it; features, the distinct feature types of those records, ascending, comma-joined; n_malformed, lines of the whole text
    with fewer than nine fields as the identifier comparison reads them. A null text is an empty file."""
    kept = [c for c in texts.columns if c != text]
    own = texts.withColumn("_lines", lines_of(F.col(text)))
    at = F.array_position(F.transform("_lines", lambda x: _starts(x, SECTION)), True)
    own = own.withColumn("cut_line", F.when(at > 0, at.cast("long")))
    own = own.withColumn("_head", F.when(F.col("cut_line").isNull(), F.col("_lines")).otherwise(F.slice("_lines", F.lit(1), (F.col("cut_line") - 1).cast("int"))))
    error = lambda x: ~_skipped(x) & ~x.rlike(NINE_TOKENS)
    first = F.array_position(F.transform("_head", error), True)
    features = F.transform(F.filter("_head", lambda x: ~_skipped(x) & x.rlike(NINE_TOKENS)), lambda x: F.regexp_extract(x, THIRD_TOKEN, 1))
    return own.select(
        *kept,
        F.size("_lines").cast("long").alias("n_lines"),
        "cut_line",
        F.when(F.exists("_head", lambda x: _starts(x, PRAGMA)), "gff3").otherwise("gtf").alias("format"),
        _count(F.col("_head"), _skipped).alias("n_skipped"),
        F.size(features).cast("long").alias("n_records"),
        _count(F.col("_head"), error).alias("n_errors"),
        F.when(first > 0, first.cast("long")).alias("first_error"),
        F.array_join(F.array_sort(F.array_distinct(features)), ",").alias("features"),
        _count(lines_of(F.col(text), "universal"), lambda x: ~_skipped(x) & ~x.rlike(NINE_FIELDS)).alias("n_malformed"),
    )
