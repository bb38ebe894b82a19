"""Annotation lines made from the TPC-H-like `lineitem` table, so that every operator runs from text at any scale.

An order is a transcript, a line number an exon slot, orders modulo two are the two annotations, eight neighbouring orders one
neighbourhood. `exon_lines` has only exons; `mixed_lines` has several features, scores, frames, comments and broken lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.attributes import once


def _keys() -> dict[str, Column]:
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    e = F.expr
    own = o % 10 < 3
    place = e("(l_orderkey div 8) * 10000 + l_linenumber * 1000")
    return {
        "src": (o % 2 + 1).cast("int"),
        "seqname": F.concat(F.lit("chr"), e("(l_orderkey div 8) % 5 + 1")),
        "strand": F.when(o % 11 == 0, ".").when(e("(l_orderkey div 8) % 3 = 0"), "-").otherwise("+"),
        "tx_id": F.concat(F.when(own, F.concat(F.lit("T"), o % 2 + 1, F.lit("_"))).otherwise("T"), e("l_orderkey div 2")),
        "gene_id": F.concat(F.when(own, F.concat(F.lit("G"), o % 2 + 1, F.lit("_"))).otherwise("G"), e("l_orderkey div 10")),
        "start": place + 1,
        "end": place + 300,
        "slot": n,
        "kind": F.col("l_returnflag"),
        "amount": F.col("l_quantity").cast("int"),
    }


def _attributes() -> Column:
    held = lambda c: F.coalesce(c, F.lit("null"))
    return F.concat(F.lit('gene_id "'), held(F.col("gene_id")), F.lit('"; transcript_id "'), held(F.col("tx_id")), F.lit('"; exon_number '), held(F.col("slot").cast("string")), F.lit(";"))


def _line(feature: Column, score: Column, frame: Column, attributes: Column) -> Column:
    return F.concat_ws("\t", "seqname", F.concat(F.lit("src"), "src"), feature, F.col("start").cast("string"), F.col("end").cast("string"), score, "strand", frame, attributes)


def _rows(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The distinct rows of the named columns, with what follows from them. Only these columns are shuffled; what is derived has no more values than they have.
    The lines of an order stand together, as those of a transcript do in a file: what is shuffled after that is compressed better. The one sort for it finds repeated rows too, so no task holds them in hash tables."""
    own = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*columns).repartition("l_orderkey")
    table = own.withColumn("copy", F.row_number().over(Window.partitionBy(*columns).orderBy(*columns))).where("copy = 1")
    return table.select(*[c.alias(k) for k, c in _keys().items() if "l_returnflag" in columns or k not in ("kind", "amount")])


def exon_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, value: one exon line for each order and slot, which all of a line follows from."""
    dot = F.lit(".")
    return _rows(spark, sf_dir, "l_orderkey", "l_linenumber").select("src", once(_line(F.lit("exon"), dot, dot, _attributes())).alias("value"))


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, format, value: exon, CDS and gene lines in both grammars (slot 4 and above is GFF3), with scores, frames, and in slot 7 comments and broken lines."""
    feature = F.when(F.col("kind") == "A", "exon").when(F.col("kind") == "N", "CDS").otherwise("gene")
    score = F.when(F.col("slot") % 3 == 0, ".").otherwise(F.concat(F.col("amount").cast("string"), F.lit(".50")))
    frame = F.when(F.col("slot") % 2 == 0, ".").otherwise((F.col("slot") % 3).cast("string"))
    gff3 = F.concat(F.lit("ID="), "tx_id", F.lit("-"), F.col("slot").cast("string"), F.lit(";Parent="), "tx_id", F.lit(";Is_circular;Note=a%20b=c"))
    fmt = F.when(F.col("slot") >= 4, "gff3").otherwise("gtf")
    line = _line(feature, score, frame, F.when(F.col("slot") >= 4, gff3).otherwise(_attributes()))
    broken = F.when(F.col("amount") % 3 == 0, F.concat(F.lit("# "), "tx_id")).when(F.col("amount") % 3 == 1, F.concat_ws("\t", "seqname", "tx_id", F.lit("exon"))).otherwise(F.lit(""))
    return _rows(spark, sf_dir, "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity").select("src", fmt.alias("format"), once(F.when(F.col("slot") == 7, broken).otherwise(line)).alias("value"))
