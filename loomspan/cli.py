"""Command line: print, filter, attrs, overlap, stats, compare, ids. Results go to stdout, or to --out as a folder of text files
written by the executors; counts go to stderr."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from pathlib import Path
from typing import NoReturn
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import comparison, identifiers, select, statistics, transcripts
from .plans import reports
from .sources import lines as src
from .sources import records as rec
from .sources.sinks import format_records, record_text, write_lines, write_parsed


class _Parser(argparse.ArgumentParser):
    def __init__(self, *args: object, code: int = 1, **options: object):
        super().__init__(*args, **options)
        self.code = code

    def error(self, message: str) -> NoReturn:
        self.print_usage(sys.stderr)
        self.exit(self.code, f"{self.prog}: error: {message}\n")


def arguments() -> argparse.ArgumentParser:
    ap = _Parser(prog="loomspan", description="Queries over GTF and GFF3 annotation files.")
    sub = ap.add_subparsers(dest="command", required=True)

    def add(name: str, text: str, *positional: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=text, code=2 if name == "ids" else 1)
        for x in positional:
            p.add_argument(x)
        p.add_argument("--out", help="write a folder of text files instead of stdout")
        return p

    add("print", "all records", "file")
    add("filter", "records of one feature type", "feature", "file")
    add("attrs", "one attribute value for each record", "key", "file")
    add("overlap", "records that overlap seqname:start-end", "region", "file")
    add("stats", "exon and intron statistics", "file")
    add("compare", "structural comparison", "file1", "file2")
    ids = add("ids", "comparison by gene and transcript ids", "file1", "file2")
    ids.add_argument("--output", choices=["merge", "only-in-1", "only-in-2"])
    ids.add_argument("--venn")
    ids.add_argument("--label1")
    ids.add_argument("--label2")
    return ap


def _emit(lines: DataFrame, order: Sequence[str], out: str | None) -> int:
    """The number of lines, counted as they go out."""
    if out:
        return write_lines(lines, out, tuple(order))
    n = 0
    for n, r in enumerate(lines.orderBy(*order).select("value").toLocalIterator(), 1):  # one partition at a time
        print(r["value"])
    return n


def _print(parsed: DataFrame, out: str | None) -> dict[str, object]:
    """Records go out, and all lines are counted, in one run of the lines."""
    if out:
        return write_parsed(parsed, out, src.ORDER)
    seen: dict[str, object] = {"parsed": 0, "skipped": 0, "errors": 0, "format": None}
    name = {"record": "parsed", "skipped": "skipped", "error": "errors"}
    text = F.when(F.col("line_kind") == "record", record_text())
    for r in parsed.orderBy(*src.ORDER).select("line_kind", "format", text.alias("value")).toLocalIterator():
        seen[name[r["line_kind"]]] += 1
        seen["format"] = max(seen["format"] or "", r["format"])
        if r["value"] is not None:
            print(r["value"])
    return seen


def _two(spark: SparkSession, file1: str, file2: str, newline: str) -> DataFrame:
    one = lambda s, f: src.read_lines(spark, f, newline).withColumn("src", F.lit(s))
    return one(1, file1).unionByName(one(2, file2))


def label_of(given: str | None, path: str) -> str:
    """The label of a file: its name, where none is given."""
    return given or Path(path).name


def unreadable(spark: SparkSession, name: str) -> str | None:
    """Why a path, or a file that it names, can't be opened; None if it can."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        found = files.globStatus(path)
        if not found:
            return "no such file"
        for f in found:
            if f.isDirectory():
                files.listStatus(f.getPath())
            else:
                files.open(f.getPath()).close()
    except Py4JJavaError as e:
        return f"can't be opened ({e.java_exception.getClass().getSimpleName()})"
    return None


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs a command; the exit code. Wrong usage and files that can't be opened give 1, wrong usage of `ids` 2."""
    try:
        a = arguments().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        region = select.parse_region(a.region) if a.command == "overlap" else None
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("loomspan").getOrCreate()
    for f in (a.file1, a.file2) if "file1" in a else (a.file,):
        if wrong := unreadable(spark, f):
            print(f"error: {f}: {wrong}", file=sys.stderr)
            return 1
    return _run(spark, a, region)


def _say(text: str) -> None:
    print(text, file=sys.stderr)


def _warn(lines: DataFrame) -> None:
    """A line for each line with too few fields."""
    for r in rec.malformed(src.numbered(lines)).select("src", "path", "line_no").orderBy("src", "path", "line_no").toLocalIterator():
        _say(f"warning: {unquote(urlparse(r['path']).path)}:{r['line_no']}: fewer than nine fields, left out")


def _run(spark: SparkSession, a: argparse.Namespace, region: select.Region | None) -> int:
    if a.command in ("print", "filter", "attrs", "overlap"):
        table = src.table_lines(src.read_lines(spark, a.file))
        recs = rec.records(table)
        if a.command == "print":
            d = _print(rec.parse_lines(table), a.out)
            _say(f"parsed={d['parsed']}  skipped={d['skipped']}  errors={d['errors']}  format={d['format'] or 'gtf'}")
            return int(d["errors"] > 0)
        if a.command == "filter":
            n = _emit(format_records(select.of_feature(recs, a.feature)), src.ORDER, a.out)
            _say(f"matched={n}  total={recs.count()}")
        elif a.command == "attrs":
            _emit(select.attribute(recs, a.key), src.ORDER, a.out)
        else:
            n = _emit(format_records(recs.where(select.in_region(region))), [*select.POSITION, *src.ORDER], a.out)
            _say(f"hits={n}  region={region.seqname}:{region.start}-{region.end}")
    elif a.command == "stats":
        exons = transcripts.exons_of(rec.records(src.read_lines(spark, a.file)))
        print(reports.stats_report(statistics.exon_intron_stats(exons)), end="")
    elif a.command == "compare":
        both = transcripts.assemble(transcripts.exons_of(rec.records(_two(spark, a.file1, a.file2, "unix")), "src"))
        counts = comparison.class_counts(comparison.classify(both))
        n = {r["src"]: r["n_tx"] for r in counts.collect()}
        for s, f in ((1, a.file1), (2, a.file2)):
            if s not in n:
                _say(f"warning: no exon features in {f}")
        _say(f"Loaded {n.get(1, 0)} + {n.get(2, 0)} transcripts.")
        print(reports.compare_report(counts, comparison.intron_counts(both.gaps), a.file1, a.file2), end="")
        both.drop()
    else:
        lines = _two(spark, a.file1, a.file2, "universal")
        _warn(lines)
        raw = rec.raw_records(lines)
        label1, label2 = label_of(a.label1, a.file1), label_of(a.label2, a.file2)
        sums = identifiers.summary(raw)
        _say(reports.id_report(sums, label1, label2))
        if a.output:
            kept = identifiers.merge(raw) if a.output == "merge" else identifiers.records_only_in(raw, 1 if a.output == "only-in-1" else 2)
            n = _emit(kept, ["src", *src.ORDER], a.out)
            _say(f"Wrote {n:,} records [{a.output}] -> {a.out or 'stdout'}")
        if a.venn:
            _say(f"Venn diagram saved -> {a.venn}" if reports.venn(sums, a.venn, label1, label2) else "Warning: the plot library is not installed; no Venn diagram")
    return 0


if __name__ == "__main__":
    sys.exit(main())
