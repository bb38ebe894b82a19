"""Text scans of annotation files, with file order, format detection and the sequence-section cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import store

ORDER = ("path", "block_start", "line_ord")


def read_lines(spark: SparkSession, path: str | list[str], newline: str = "unix", folders: bool = False) -> DataFrame:
    """path, block_start, line_ord, value. newline 'unix' splits at line feeds only and keeps carriage returns, 'universal' splits at both.
    (block_start, line_ord) is the order within a file, also over several splits. Compressed files work as Spark reads them.

    folders: the part files of a folder, in the order of their names, are one file, as Spark writes a file that is too large for one task. path is then the folder, and block_start the part
    and the place in it."""
    reader = spark.read.option("lineSep", "\n") if newline == "unix" else spark.read
    own, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    part = F.substring_index(own, "/", -1)
    if folders:
        own, start = F.substr(own, F.lit(1), F.length(own) - F.length(part)), F.struct(F.length(F.substring_index(part, "-", 2)).alias("digits"), part.alias("part"), start.alias("start"))
    return reader.text(path).select(own.alias("path"), start.alias("block_start"), F.monotonically_increasing_id().alias("line_ord"), "value")


def at() -> Column:
    return F.struct("block_start", "line_ord")


FEW_FILES = 100_000  #: files, at some hundred bytes each, up to which their marks are broadcast


def file_marks(lines: DataFrame) -> DataFrame:
    """path, cut, format of each file that has a mark: the place of its first line that starts with ##FASTA (null without one), and 'gff3' if a line before that starts with
    ##gff-version, else 'gtf'. One pass, of which a row for each file is left."""
    first = lambda mark: F.min(F.when(F.startswith("value", F.lit(mark)), at()))
    found = lines.where(F.startswith("value", F.lit("##"))).groupBy("path").agg(first("##FASTA").alias("cut"), first("##gff-version").alias("pragma")).where("cut is not null or pragma is not null")
    gff3 = F.col("pragma").isNotNull() & (F.col("cut").isNull() | (F.col("pragma") < F.col("cut")))
    return found.select("path", "cut", F.when(gff3, "gff3").otherwise("gtf").alias("format"))


def table_lines(lines: DataFrame) -> DataFrame:
    """Lines before the first one that starts with ##FASTA of each file, with `format`: 'gff3' if any of them starts with ##gff-version, else 'gtf'.
    The marks of the files are read first, and stored; the lines then meet them, file by file."""
    marks = store(file_marks(lines), "marks")
    kept = lines.join(F.broadcast(marks) if marks.count() <= FEW_FILES else marks, "path", "left").where(F.col("cut").isNull() | (at() < F.col("cut")))
    return kept.select(*lines.columns, F.coalesce("format", F.lit("gtf")).alias("format"))


def numbered(lines: DataFrame) -> DataFrame:
    """lines with line_no, from 1 in each file: the place in its block after all lines of the blocks before. One row for each block is ordered over a file."""
    block = ["path", "block_start"]
    before = Window.partitionBy("path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    held = lines.groupBy(*block).agg(F.count("*").alias("held"), F.min("line_ord").alias("first_ord"))
    base = held.select(*block, "first_ord", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("line_base"))
    return lines.join(base, block).withColumn("line_no", F.expr("line_base + line_ord - first_ord + 1")).select(*lines.columns, "line_no")
