"""Job 2: intake of texts that may be annotation files, as they arrive.

    python -m jobs.text_intake --config jobs/text_intake.json [--input TABLE] [--output FOLDER] [--checkpoint FOLDER]

Someone who collects annotation files wants to know of each new one, before it is used, its format, where its sequence section begins, how many records it has, of which features, and which lines
are broken. The job takes a growing table of texts (Parquet files; a text is a file) as a stream, reads each text by the rules of the annotation reader, and writes a
row for each text, as Parquet partitioned by micro-batch and language.

The checkpoint knows which input files were taken, so a run takes only new ones, and ends when there are none. A micro-batch that is run again after a failure replaces its own partitions,
so no text is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, command_line, counted, session, settings
from loomspan.sources import texts
from loomspan.sources.workspace import new_path

SCHEMA = "doc_id long, source string, n_lines long, cut_line long, format string, n_skipped long, n_records long, n_errors long, first_error long, features string, n_malformed long, batch long, lang string"


def run(spark: SparkSession, table: str, output: str, checkpoint: str, files_per_batch: int = 1000) -> DataFrame:
    """Takes what is new in `table` since the last run with this checkpoint; all of the output read back."""
    # As a pattern, so that a table that is one file is taken as well as a folder of files.
    pattern = f"{table.rstrip('/')[:-1]}[{table.rstrip('/')[-1]}]"
    taken = spark.readStream.schema(spark.read.parquet(table).schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern).select("doc_id", "lang", "source", "text")
    counts: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        rows, written = counted(texts.digest(batch).withColumn("batch", F.lit(number).cast("long")))
        rows.select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "lang").parquet(output)
        counts.append(written.get["n"])
        LOG.info("batch %d: wrote %d texts to %s", number, counts[-1], output)

    query = taken.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    LOG.info("read %d new texts of %s in %d batches", sum(counts), table, len(counts))
    return spark.read.schema(SCHEMA).parquet(output)


ORACLE = r"""WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
l AS (SELECT *, string_split(text, chr(10)) AS a, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS b FROM t),
m AS (SELECT doc_id, lang, source, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a, CASE WHEN b[-1] = '' THEN b[:-2] ELSE b END AS b FROM l),
c AS (SELECT *, CAST(list_position(list_transform(a, lambda x: starts_with(x, '##FASTA')), true) AS BIGINT) AS cut FROM m),
h AS (SELECT *, CASE WHEN cut > 0 THEN cut END AS cut_line, CASE WHEN cut > 0 THEN a[:cut - 1] ELSE a END AS head FROM c),
k AS (SELECT *, list_transform(head, lambda x: CASE WHEN x = '' OR starts_with(x, '#') THEN 'skipped' WHEN len(list_filter(string_split(x, chr(9)), lambda y: y <> '')) >= 9 THEN 'record' ELSE 'error' END) AS kind FROM h)
SELECT doc_id, lang, source, len(a) AS n_lines, cut_line, CASE WHEN len(list_filter(head, lambda x: starts_with(x, '##gff-version'))) > 0 THEN 'gff3' ELSE 'gtf' END AS format,
 len(list_filter(kind, lambda x: x = 'skipped')) AS n_skipped, len(list_filter(kind, lambda x: x = 'record')) AS n_records, len(list_filter(kind, lambda x: x = 'error')) AS n_errors,
 CASE WHEN list_position(kind, 'error') > 0 THEN CAST(list_position(kind, 'error') AS BIGINT) END AS first_error,
 coalesce(array_to_string(list_sort(list_distinct(list_transform(list_filter(head, lambda x, i: kind[i] = 'record'), lambda x: list_filter(string_split(x, chr(9)), lambda y: y <> '')[3]))), ','), '') AS features,
 len(list_filter(b, lambda x: x <> '' AND NOT starts_with(x, '#') AND len(string_split(x, chr(9))) < 9)) AS n_malformed FROM k"""


def job2_text_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job, twice into one new folder and checkpoint, and its output after that."""
    folder = new_path(spark, "job2")
    for _ in range(2):
        table = run(spark, f"{sf_dir}/documents.parquet", f"{folder}/table", f"{folder}/checkpoint")
    return table.drop("batch")


def main() -> None:
    given = command_line(__doc__.splitlines()[0], "input", "output", "checkpoint")
    spark = session("text_intake")
    try:
        s = settings(spark, given)
        run(spark, str(s["input"]), str(s["output"]), str(s["checkpoint"]), int(s.get("files_per_batch") or 1000))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
