"""Text sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.numbers import six_digits
from .workspace import drop, store


def record_text(score: Column | None = None) -> Column:
    """A record as a line: missing score and frame are points, scores have six significant digits."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    score = F.coalesce(six_digits("score") if score is None else score, F.lit("."))
    return F.concat_ws("\t", "seqname", "source", "feature", text("start"), text("end"), score, "strand", text("frame"), "attributes")


def format_records(recs: DataFrame) -> DataFrame:
    """value: the text line of each record, and recs' columns."""
    return recs.withColumn("value", record_text())


def _write(lines: DataFrame, path: str) -> int:
    seen = Observation()
    lines.select("value").observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").text(path)
    return seen.get["n"]


def write_parsed(parsed: DataFrame, path: str, order: tuple[str, ...]) -> dict[str, object]:
    """The records among parsed lines (parse_lines, with `format`) to a folder of text files, in order; what the same run saw: parsed, skipped, errors, format (null without lines).
    The metric stands above the sort, as what is below runs once more for the bounds of the ranges."""
    seen = Observation()
    n = lambda kind, name: F.count_if(F.col("line_kind") == kind).alias(name)
    watched = parsed.orderBy(*order).observe(seen, n("record", "parsed"), n("skipped", "skipped"), n("error", "errors"), F.max("format").alias("format"))
    watched.where("line_kind = 'record'").select(record_text().alias("value")).write.mode("overwrite").text(path)
    return seen.get


def write_records(recs: DataFrame, path: str, order: tuple[str, ...] = ()) -> int:
    """Lines to a folder of text files; their number, counted as they are written. Range-partitioned by `order`, so that the part files, in their order, hold the records in order, without one task writing all."""
    lines = format_records(recs)
    return _write(lines.orderBy(*order) if order else lines, path)


def write_lines(raw: DataFrame, path: str, order: tuple[str, ...]) -> int:
    """Raw lines (`value`), unchanged, in the given order; their number."""
    return _write(raw.orderBy(*order), path)


def write_table(recs: DataFrame, path: str) -> None:
    """Records as Parquet, ranged and sorted by position: a region query then reads only the files and row groups whose bounds meet it.
    Spark runs what is below a range twice, first for its bounds: the records are stored before, so that lines are parsed once."""
    held = store(recs, "records")
    held.repartitionByRange("seqname", "start").sortWithinPartitions("seqname", "start", "end").write.mode("overwrite").parquet(path)
    drop(held)
