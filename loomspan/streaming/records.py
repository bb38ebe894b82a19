"""Annotation lines as a stream.

Parsing, filters and attribute look-ups are column expressions without state, so they are the same as on tables (stream_records); there the format is given. A file source gives each file whole,
in one micro-batch. So what needs the order of a file, the sequence section and the format pragma, is settled batch by batch (table_stream), and needs no state beyond the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.lines import table_lines
from ..sources.records import parse_lines, records


def _lines(spark: SparkSession, path: str, files_per_trigger: int | None) -> DataFrame:
    reader = spark.readStream.option("lineSep", "\n")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block_start"), "value")


def stream_records(spark: SparkSession, path: str, fmt: str = "gtf", files_per_trigger: int | None = None) -> DataFrame:
    """Records of files that arrive in a folder, with their path and `format`."""
    return records(_lines(spark, path, files_per_trigger).drop("block_start")).withColumn("format", F.lit(fmt))


def table_stream(spark: SparkSession, path: str, output: str, checkpoint: str, files_per_trigger: int | None = None) -> DataFrame:
    """Takes the files that have arrived since the last run with this checkpoint, reads each as sources.lines.table_lines does, and writes its parsed lines, with their kinds, as Parquet, by
    micro-batch. A batch that is run again replaces its own lines. All of the output read back."""

    def write(batch: DataFrame, number: int) -> None:
        lines = batch.select("path", "block_start", F.monotonically_increasing_id().alias("line_ord"), "value")
        parse_lines(table_lines(lines)).drop("value").withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(output)

    query = _lines(spark, path, files_per_trigger).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.parquet(output)


def feature_totals(recs: DataFrame) -> DataFrame:
    """Running count for each feature; to be written in complete or update mode."""
    return recs.groupBy("feature").agg(F.count("*").alias("n"))
