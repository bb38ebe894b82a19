"""Structural comparison of two annotations (src 1 and 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import percent
from .intervals import levels_in, overlap_join
from .transcripts import Assembly, assign_locus, distinct_introns, locus_bases, number_loci

REACH_BIN = 1 << 20  #: positions that one task of the search for partners handles

# Classes, best first. '=' same intron chain, 'j' some introns shared, 'o' overlap only, 'u' nothing overlaps.
CLASSES = ("=", "j", "o", "u")

_INTRON = ["seqname", "strand", "start", "end"]


def overlapping_pairs(tx: DataFrame) -> DataFrame:
    """Pairs (a of src 1, b of src 2) on one sequence and strand whose closed spans overlap. tx is read twice, and once for the levels of its spans: a stored table."""
    side = lambda s: tx.where(F.col("src") == s).select("seqname", "strand", "tx_id", "start", "end", "n_introns")
    levels = levels_in(tx)
    return overlap_join(side(1), side(2), ["seqname", "strand"], levels, levels)


def with_shared(pairs: DataFrame, introns: DataFrame) -> DataFrame:
    """pairs with `shared`, the number of distinct introns that both have: introns meet introns, and are counted for each pair of transcripts."""
    one = lambda s, name: introns.where(F.col("src") == s).select(*_INTRON, F.col("tx_id").alias(name))
    both = one(1, "a_tx_id").join(one(2, "b_tx_id"), _INTRON).groupBy("a_tx_id", "b_tx_id").agg(F.count("*").cast("int").alias("shared"))
    return pairs.join(both, ["a_tx_id", "b_tx_id"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))


def pair_class(pairs: DataFrame) -> DataFrame:
    """pairs (with shared) with pair_class and its rank (3 for =, 2 for j, 1 for o). The class is the same seen from either side."""
    same = (F.col("a_n_introns") > 0) & (F.col("shared") == F.col("a_n_introns")) & (F.col("shared") == F.col("b_n_introns"))
    rank = F.when(same, 3).when(F.col("shared") > 0, 2).otherwise(1)
    return pairs.withColumn("rank", rank).withColumn("pair_class", F.array(*map(F.lit, reversed(CLASSES)))[F.col("rank")])


def mark_partners(tx: DataFrame, width: int = REACH_BIN, spans: DataFrame | None = None, loci: bool = False) -> DataFrame:
    """tx with `partner`: it overlaps a transcript of the other source. No pair is made.

    In the order of starts, a partner stands before a transcript, and the greatest end there reaches its start, or behind it, and the next start there is not beyond its end. Transcripts are ordered
    within bins of starts; each bin begins with rows that hold the greatest end before it, and closes with rows that hold the next start behind it, for each source.

    spans: the table (stored) whose spans tx has, where tx is costly to read twice. loci: adds `locus`, as assign_locus, from the same order."""
    place = ["bin", "seqname", "strand"]
    own = lambda df: df.withColumn("bin", F.expr(f"start div {width}"))
    of = lambda s, c: F.when(F.col("src") == s, F.col(c))
    bins = Window.partitionBy("seqname", "strand").orderBy("bin")
    earlier = bins.rowsBetween(Window.unboundedPreceding, -1)
    spans = tx if spans is None else spans
    held = own(spans).groupBy(*place).agg(*[f(of(s, c)).alias(f"{c}_{s}") for s in (1, 2) for f, c in ((F.max, "end"), (F.min, "start"))])
    later = lambda s: F.expr(f"lead(start_{s}) ignore nulls over (partition by seqname, strand order by bin)")
    none = F.lit(None).cast("long")
    border = lambda row, s, start, end: F.struct(F.lit(row).alias("row"), F.lit(s).alias("src"), start.alias("start"), end.alias("end"))
    sides = held.select(*place, *[F.max(f"end_{s}").over(earlier).alias(f"reach_{s}") for s in (1, 2)], *[later(s).alias(f"later_{s}") for s in (1, 2)])
    borders = sides.select(*place, F.explode(F.array(*[b for s in (1, 2) for b in (border(0, s, none, F.col(f"reach_{s}")), border(2, s, F.col(f"later_{s}"), none))])).alias("b")).select(*place, "b.*")
    rows = own(tx).withColumn("row", F.lit(1)).unionByName(borders.where("start is not null or end is not null"), allowMissingColumns=True)
    if loci:
        rows = rows.unionByName(locus_bases(spans, width).withColumn("row", F.lit(0)), allowMissingColumns=True)
    within = Window.partitionBy(*place).orderBy("row", "start", "end")
    before = lambda s: F.max(of(s, "end")).over(within.rowsBetween(Window.unboundedPreceding, -1))
    behind = lambda s: F.expr(f"lead(if(src = {s}, start, null)) ignore nulls over (partition by bin, seqname, strand order by row, start, `end`)")
    swept = (number_loci(rows) if loci else rows).withColumns({f"before_{s}": before(s) for s in (1, 2)} | {f"behind_{s}": behind(s) for s in (1, 2)}).where("row = 1")
    other = lambda c: F.when(F.col("src") == 1, F.col(f"{c}_2")).otherwise(F.col(f"{c}_1"))
    partner = F.coalesce(other("before") >= F.col("start"), F.lit(False)) | F.coalesce(other("behind") <= F.col("end"), F.lit(False))
    return swept.select(*tx.columns, partner.alias("partner"), *(["locus"] if loci else []))


def with_partner(tx: DataFrame, width: int = REACH_BIN) -> DataFrame:
    """src, tx_id of the transcripts that overlap one of the other source."""
    return mark_partners(tx, width).where("partner").select("src", "tx_id")


def mark_twins(tx: DataFrame) -> DataFrame:
    """tx (of an assembly) with `twin` in place of its chain: the other source has a transcript with the same chain of introns, which need not be distinct."""
    chain = Window.partitionBy("chain_x", "chain_y", "n_introns", "seqname", "strand")
    return tx.withColumn("twin", (F.col("n_introns") > 0) & (F.min("src").over(chain) != F.max("src").over(chain))).drop("chain_x", "chain_y")


def shared_introns(gaps: DataFrame) -> DataFrame:
    """src, tx_id of the transcripts with an intron that the other source has too (shared) or that stands twice in the transcript (repeated)."""
    order = Window.partitionBy("start", "end", "seqname", "strand").orderBy("tx_id", "src")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.lag(F.struct("tx_id", "src")).over(order)
    seen = gaps.select("src", "tx_id", (F.min("src").over(whole) != F.max("src").over(whole)).alias("shared"), F.coalesce(before == F.struct("tx_id", "src"), F.lit(False)).alias("repeated"))
    return seen.where("shared or repeated").groupBy("tx_id", "src").agg(F.max("shared").alias("shared"), F.max("repeated").alias("repeated"))


def classify(assembly: Assembly, loci: bool = False) -> DataFrame:
    """The transcripts with cmp_class: the best class over all partners, u without any. loci: with `locus` too.

    Transcripts that share an intron overlap, as long as no exon ends before it starts, so no pair is made: a twin has the same chain, none of whose introns stands twice. Where an exon ends before
    it starts, transcripts may share an intron and not overlap; then, and only then, the classes come from the pairs."""
    tx = assembly.tx
    key = ["tx_id", "src"]
    if tx.where("reversed").isEmpty():
        marked = mark_partners(mark_twins(tx), spans=tx, loci=loci).join(shared_introns(assembly.gaps), key, "left")
        found = F.when(F.col("twin") & ~F.coalesce("repeated", F.lit(False)), "=").when(F.col("shared"), "j").when(F.col("partner"), "o").otherwise("u")
        return marked.withColumn("cmp_class", found).drop("reversed", "twin", "partner", "shared", "repeated")
    pairs = pair_class(with_shared(overlapping_pairs(tx), assembly.introns))
    end = lambda s, c: F.struct(F.lit(s).alias("src"), F.col(c).alias("tx_id"))
    ranks = pairs.select(F.explode(F.array(end(1, "a_tx_id"), end(2, "b_tx_id"))).alias("t"), "rank").select("t.src", "t.tx_id", "rank")
    best = ranks.groupBy(*key).agg(F.max("rank").alias("rank"))
    return (assign_locus(tx) if loci else tx).join(best, key, "left").withColumn("cmp_class", F.array(*map(F.lit, reversed(CLASSES)))[F.coalesce("rank", F.lit(0))]).drop("rank", "reversed", "chain_x", "chain_y")


def class_counts(classified: DataFrame) -> DataFrame:
    """src, n_tx, n_exact, n_partial, n_overlap, n_unique."""
    count = lambda c, name: F.count_if(F.col("cmp_class") == c).alias(name)
    return classified.groupBy("src").agg(F.count("*").alias("n_tx"), count("=", "n_exact"), count("j", "n_partial"), count("o", "n_overlap"), count("u", "n_unique"))


def class_percentages(classified: DataFrame) -> DataFrame:
    n = F.col("n_tx")
    return class_counts(classified).select("src", *[percent(F.col(f"n_{c}"), n).alias(f"pct_{c}") for c in ("exact", "partial", "overlap", "unique")])


def intron_counts(introns: DataFrame) -> DataFrame:
    """One row: n_introns_1, n_introns_2, n_shared (distinct introns), pct_shared_1, pct_shared_2. One aggregate over both sources tells who has each intron."""
    has = distinct_introns(introns).groupBy("seqname", "strand", "start", "end").agg(F.max(F.expr("int(src = 1)")).alias("one"), F.max(F.expr("int(src = 2)")).alias("two"))
    sums = has.agg(F.count_if(F.col("one") == 1).alias("n_introns_1"), F.count_if(F.col("two") == 1).alias("n_introns_2"), F.count_if((F.col("one") == 1) & (F.col("two") == 1)).alias("n_shared"))
    return sums.withColumns({f"pct_shared_{s}": percent(F.col("n_shared"), F.col(f"n_introns_{s}")) for s in (1, 2)})


def sensitivity_precision(classified: DataFrame) -> DataFrame:
    """One row: sensitivity (src 1) and precision (src 2); null unless both have transcripts."""
    part = lambda s: F.count_if(F.col("src") == s)
    exact = lambda s: F.count_if((F.col("src") == s) & (F.col("cmp_class") == "="))
    both = (part(1) > 0) & (part(2) > 0)
    return classified.agg(F.when(both, F.lit(100.0) * exact(1) / part(1)).alias("sensitivity"), F.when(both, F.lit(100.0) * exact(2) / part(2)).alias("precision"))
