"""Exons to transcripts, introns, loci."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.attributes import token_id
from ..sources.workspace import drop, store

BIN = 1 << 20  #: positions that one task of the locus sweep handles
EXON_BIN = 1 << 17  #: positions in which the exons of a transcript are ordered together


def exons_of(recs: DataFrame, *keep: str) -> DataFrame:
    """keep..., seqname, strand, tx_id, gene_id, start, end of exon records; a missing id is ''."""
    return recs.where(F.col("feature") == "exon").select(*keep, "seqname", "strand", token_id(F.col("attributes"), "transcript_id").alias("tx_id"), token_id(F.col("attributes"), "gene_id").alias("gene_id"), "start", "end")


def build_transcripts(exons: DataFrame) -> DataFrame:
    """exons with src -> src, tx_id, seqname, strand, gene_id, start, end, n_exons, n_introns, reversed (an exon ends before it starts).

    Grouped by id alone; sequence, strand and gene are those of the exon with the least start (then end, then names). Sums and extremes only, so exons without an id, which are one
    transcript, are no large group."""
    first = F.min(F.struct("start", "end", "seqname", "strand", "gene_id"))
    own = exons.groupBy("src", "tx_id").agg(first.alias("first"), F.max("end").alias("last"), F.count("*").cast("int").alias("n"), F.bool_or(F.col("end") < F.col("start")).alias("reversed"))
    head = F.col("first")
    return own.select("src", "tx_id", head["seqname"].alias("seqname"), head["strand"].alias("strand"), head["gene_id"].alias("gene_id"), head["start"].alias("start"), F.col("last").alias("end"), F.col("n").alias("n_exons"), (F.col("n") - 1).alias("n_introns"), "reversed")


def introns_of(exons: DataFrame, width: int = EXON_BIN) -> DataFrame:
    """src, tx_id, seqname, strand, start, end of each intron: what lies between two exons that follow each other by (start, end), kept also where it is empty.

    The exons of a transcript are ordered within bins of starts. Each bin gets one more row, which stands last: the first start of the transcript's next bin, and the sequence and strand of its
    very first exon. Only one row for each bin is ordered over a whole transcript."""
    own = exons.withColumn("bin", F.expr(f"start div {width}"))
    by = ["src", "tx_id", "bin"]
    first = own.groupBy(*by).agg(F.min(F.struct("start", "end", "seqname", "strand", "gene_id")).alias("first"))
    bins = Window.partitionBy("src", "tx_id").orderBy("bin")
    border = first.select(*by, F.lit(1).alias("border"), F.lead("first.start").over(bins).alias("start"), F.lit(None).cast("long").alias("end"), F.first("first").over(bins).alias("head"))
    rows = own.select(*by, F.lit(0).alias("border"), "start", "end").unionByName(border, allowMissingColumns=True)
    within = Window.partitionBy(*by)
    after = rows.withColumn("next", F.lead("start").over(within.orderBy("border", "start", "end"))).withColumn("head", F.max("head").over(within))
    return after.where("border = 0 and next is not null").select("src", "tx_id", "head.seqname", "head.strand", (F.col("end") + 1).alias("start"), (F.col("next") - 1).alias("end"))


def distinct_introns(introns: DataFrame) -> DataFrame:
    return introns.select("src", "seqname", "strand", "start", "end").distinct()


@dataclass(frozen=True)
class Assembly:
    """Transcripts and their introns, from tables that are stored once."""

    tx: DataFrame  #: as build_transcripts, and chain_x, chain_y: 128 bits that tell chains of introns apart, whatever their order
    gaps: DataFrame  #: src, tx_id, seqname, strand, start, end: introns, with repeats
    tables: tuple[DataFrame, ...]  #: the stored tables

    @property
    def introns(self) -> DataFrame:
        """The distinct introns of each transcript."""
        return self.gaps.distinct()

    def drop(self) -> None:
        drop(*self.tables)


def _marks(start: Column, end: Column) -> dict[str, Column]:
    return {"x": F.xxhash64(start, end), "y": F.xxhash64(end, start, F.lit(1))}


def exon_steps(exons: DataFrame, width: int = EXON_BIN) -> DataFrame:
    """exons in order within bins of starts: tx_id, src, bin, seqname, strand (of the bin's first exon), tail (the exon's end), next (the start that follows in the bin, null for the last
    exon of a bin) and, with that last exon alone, what the bin adds up to: first, last (the greatest end), n, reversed, x, y (of its introns).

    One shuffle and one sort; what adds up is carried along, so no task holds a bin in memory."""
    by = ["tx_id", "src", "bin"]  # a name tells more rows apart than a source does, so sorts compare less
    order = ["start", "end", "seqname", "strand", "gene_id"]
    within = Window.partitionBy(*by).orderBy(*order)
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    own = exons.withColumn("bin", F.expr(f"start div {width}"))
    held = {"next": F.lead("start").over(within), "first": F.first(F.struct(*order)).over(so_far), "last": F.max("end").over(so_far), "n": F.count("*").over(so_far), "reversed": F.max(F.col("end") < F.col("start")).over(so_far)}
    steps = own.select(*by, F.col("end").alias("tail"), *[c.alias(k) for k, c in held.items()], *order)
    is_last = F.col("next").isNull()
    marks = {k: F.bit_xor(F.when(~is_last, c)).over(so_far) for k, c in _marks(F.col("tail") + 1, F.col("next") - 1).items()}
    whole = [F.when(is_last, F.col(c)).alias(c) for c in ("first", "last", "n", "reversed", *marks)]
    return steps.withColumns(marks).select(*by, "first.seqname", "first.strand", "tail", "next", *whole)


def join_bins(steps: DataFrame) -> DataFrame:
    """A row for each bin of a transcript: tx_id, src, bin, head (the transcript's first exon), tail, next (the first start of the next bin, null for the last bin), moved (the bin begins on
    another sequence or strand than the transcript) and what the bins up to here add up to. Only one row for each bin is ordered over a transcript."""
    bins = Window.partitionBy("tx_id", "src").orderBy("bin")
    so_far = bins.rowsBetween(Window.unboundedPreceding, 0)
    ends = steps.where("n is not null").select("tx_id", "src", "bin", "first", "tail", "last", "n", "reversed", "x", "y", F.lead("first.start").over(bins).alias("next"), F.first("first").over(so_far).alias("head"))
    border = _marks(F.col("tail") + 1, F.col("next") - 1)
    mark = lambda k: F.coalesce(k, F.lit(0)).bitwiseXOR(F.when(F.col("next").isNotNull(), border[k]).otherwise(0))
    moved = (F.col("first.seqname") != F.col("head.seqname")) | (F.col("first.strand") != F.col("head.strand"))
    sums = {"last": F.max("last"), "n": F.sum("n"), "reversed": F.max("reversed"), "x": F.bit_xor(mark("x")), "y": F.bit_xor(mark("y"))}
    return ends.select("tx_id", "src", "bin", "head", "tail", "next", moved.alias("moved"), *[c.over(so_far).alias(k) for k, c in sums.items()])


def assemble(exons: DataFrame, width: int = EXON_BIN) -> Assembly:
    """Transcripts and introns. Exons are ordered once, and stored as introns; lines are read and parsed once."""
    steps = store(exon_steps(exons, width), "introns")
    bins = store(join_bins(steps), "transcripts")
    n = F.col("n").cast("int")
    tx = bins.where("next is null").select("src", "tx_id", "head.seqname", "head.strand", "head.gene_id", "head.start", F.col("last").alias("end"), n.alias("n_exons"), (n - 1).alias("n_introns"), "reversed", F.col("x").alias("chain_x"), F.col("y").alias("chain_y"))
    inner = steps.where("next is not null")
    moved = bins.where("moved").select("tx_id", "src", "bin", F.col("head.seqname").alias("own_seqname"), F.col("head.strand").alias("own_strand"))
    if not moved.isEmpty():
        inner = inner.join(moved, ["tx_id", "src", "bin"], "left").withColumns({c: F.coalesce(f"own_{c}", c) for c in ("seqname", "strand")})
    intron = [(F.col("tail") + 1).alias("start"), (F.col("next") - 1).alias("end")]
    border = bins.where("next is not null").select("src", "tx_id", "head.seqname", "head.strand", *intron)
    return Assembly(tx, inner.select("src", "tx_id", "seqname", "strand", *intron).unionByName(border), (steps, bins))


def locus_bases(tx: DataFrame, width: int = BIN) -> DataFrame:
    """bin, seqname, strand, end, base of each bin of starts: the greatest end and the number of loci before it. Each bin by itself gives its greatest end and the starts of its own runs."""
    bins = ["bin", "seqname", "strand"]  # a number first: sorts compare it alone, mostly
    own = tx.withColumn("bin", F.expr(f"start div {width}"))
    before = F.max("end").over(Window.partitionBy(*bins).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    runs = own.select(*bins, "start", "end", before.alias("before")).groupBy(*bins).agg(F.max("end").alias("last"), F.collect_list(F.when(F.col("before").isNull() | (F.col("start") > F.col("before")), F.col("start"))).alias("heads"))
    earlier = Window.partitionBy("seqname", "strand").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    reach = runs.withColumn("end", F.max("last").over(earlier))
    opened = F.size(F.filter("heads", lambda h: F.col("end").isNull() | (h > F.col("end"))))
    return reach.withColumn("opened", opened).select(*bins, "end", F.coalesce(F.sum("opened").over(earlier), F.lit(0)).alias("base"))


def number_loci(rows: DataFrame) -> DataFrame:
    """rows (row, bin, seqname, strand, start, end, base) with `locus`. In each bin, those of locus_bases (row 0) stand before its transcripts (row 1): what starts up to an end before it opens no locus."""
    order = Window.partitionBy("bin", "seqname", "strand").orderBy("row", "start", "end")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.when((F.col("row") == 1) & (F.col("covered").isNull() | (F.col("start") > F.col("covered"))), 1).otherwise(0)
    covered = rows.withColumn("covered", F.max("end").over(before))
    return covered.withColumn("locus", F.coalesce(F.max("base").over(so_far), F.lit(0)) + F.sum(opens).over(so_far)).drop("covered")


def assign_locus(tx: DataFrame, width: int = BIN) -> DataFrame:
    """tx with `locus`: the number, within sequence and strand, of the run of transcripts that overlap without a gap. A parallel prefix over bins of starts."""
    rows = tx.withColumn("bin", F.expr(f"start div {width}")).withColumn("row", F.lit(1))
    return number_loci(rows.unionByName(locus_bases(tx, width).withColumn("row", F.lit(0)), allowMissingColumns=True)).where("row = 1").select(*tx.columns, "locus")
