"""Filters, projections, regions and ordering of records."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.attributes import value_of
from ..sources.records import with_pairs
from ..sources.workspace import drop, store
from .intervals import LEVELS, level_of, levels_in, overlap_join

POSITION = ("seqname", "start", "end")
FEW = 100_000  #: rows, of some tens of bytes each, up to which a counted table is broadcast


@dataclass(frozen=True)
class Region:
    seqname: str
    start: int
    end: int


def parse_region(text: str) -> Region:
    """seqname:start-end, split at the last colon; what follows the second number is ignored. ValueError if it is no region."""
    name, colon, rest = text.rpartition(":")
    if not colon:
        raise ValueError(f"invalid region '{text}': expected seqname:start-end")
    if not 1 <= len(name.encode()) <= 255:
        raise ValueError(f"seqname in region '{text}' is empty or too long")
    m = re.match(r"\s*([+-]?[0-9]+)-\s*([+-]?[0-9]+)", rest)
    if not m or int(m[1]) > int(m[2]):
        raise ValueError(f"invalid coordinates in region '{text}'")
    return Region(name, int(m[1]), int(m[2]))


def region_columns(text: Column) -> Column:
    """parse_region for a column: a struct of seqname, start, end; null where the text is no region. Numbers of more than 18 digits are none."""
    name, rest = F.regexp_extract(text, "(?s)^(.*):", 1), F.substring_index(text, ":", -1)
    number = lambda g: F.regexp_extract(rest, r"^[ \t\n\x0B\f\r]*([+-]?[0-9]{1,18})-[ \t\n\x0B\f\r]*([+-]?[0-9]{1,18})(?![0-9])", g).try_cast("bigint")
    named = (F.instr(text, ":") > 0) & F.octet_length(name).between(1, 255)
    return F.when(named & (number(1) <= number(2)), F.struct(name.alias("seqname"), number(1).alias("start"), number(2).alias("end")))


def of_feature(recs: DataFrame, feature: str) -> DataFrame:
    """Records of exactly this feature type."""
    return recs.where(F.col("feature") == feature)


def in_region(region: Region) -> Column:
    """Closed intervals that share a position with the region."""
    return (F.col("seqname") == region.seqname) & (F.col("start") <= region.end) & (F.col("end") >= region.start)


def overlapping(recs: DataFrame, region: Region | str) -> DataFrame:
    """Records that overlap a region, by position. The filter reaches the scan of a Parquet copy."""
    return by_position(recs.where(in_region(parse_region(region) if isinstance(region, str) else region)))


def by_position(recs: DataFrame, *ties: str) -> DataFrame:
    return recs.orderBy(*POSITION, *ties)


def attribute(recs: DataFrame, key: str, fmt: Column | None = None) -> DataFrame:
    """recs with `value`: the first value of a key, a point where it is missing ('' stays)."""
    own = value_of(F.col("attributes"), fmt if fmt is not None else F.col("format"), key)
    return recs.withColumn("value", F.coalesce(own, F.lit(".")))


def attribute_pairs(recs: DataFrame, fmt: Column | None = None) -> DataFrame:
    """One row for each pair: recs' columns, place, key, value."""
    # The outer form: for the inner one Catalyst infers filters on the list, which would read the attributes two times more.
    rows = with_pairs(recs, fmt).select(*recs.columns, F.posexplode_outer("pairs").alias("place", "pair"))
    return rows.where("place is not null").select(*recs.columns, "place", "pair.key", "pair.value")


def feature_counts(recs: DataFrame) -> DataFrame:
    return recs.groupBy("feature").agg(F.count("*").alias("n"))


def value_counts(recs: DataFrame, key: str, fmt: Column | None = None) -> DataFrame:
    """How many records have each value of an attribute."""
    return attribute(recs, key, fmt).groupBy("value").agg(F.count("*").alias("n"))


def position_rank(recs: DataFrame, *ties: str) -> DataFrame:
    """Rank of each record by start and end within its sequence. The records are sorted once, over ranges that Spark samples, so neither a large sequence nor a dense stretch of it is one task;
    the sorted table is stored, and what stands before each of its parts follows from their counts. The records are stored before too, as Spark runs what is below a range twice, first for its bounds."""
    own = store(recs, "records")
    held = store(own.orderBy(*POSITION, *ties).select("*", F.spark_partition_id().alias("rank_part"), F.monotonically_increasing_id().alias("rank_place")), "sorted")
    drop(own)
    part = ["seqname", "rank_part"]
    before = Window.partitionBy("seqname").orderBy("rank_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = held.groupBy(*part).agg(F.count("*").alias("held"), F.min("rank_place").alias("rank_first"))
    base = store(counts.select(*part, "rank_first", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("rank_base")), "ranks")
    joined = held.join(F.broadcast(base) if base.count() <= FEW else base, part)
    return joined.withColumn("rank", F.expr("rank_base + rank_place - rank_first + 1")).select(*recs.columns, "rank")


def _regions(regions: DataFrame) -> DataFrame:
    return regions.select("region_id", "seqname", "start", "end")


def overlapping_regions(recs: DataFrame, regions: DataFrame) -> DataFrame:
    """Records joined with a table of regions (region_id, seqname, start, end) that they overlap: recs' columns, region_id, region_start, region_end. Records are read once."""
    pairs = overlap_join(recs, _regions(regions), ["seqname"], LEVELS, levels_in(regions))
    own = [F.col("seqname") if c == "seqname" else F.col(f"a_{c}").alias(c) for c in recs.columns]
    return pairs.select(*own, F.col("b_region_id").alias("region_id"), F.col("b_start").alias("region_start"), F.col("b_end").alias("region_end"))


#: Widths of the bins of a stored table, level by level, as powers of two. Each bin is a folder with a file: the first width is that of a fourth of a human chromosome, so that files are few and
#: hold many records, which lie in the order of their starts.
TABLE_POWERS = (26, 34, 42, 50, 62)
MOST_BINS = 64  #: bins of a level that a region names outright; beyond, it takes those that the table has


def write_binned(recs: DataFrame, path: str) -> None:
    """Records as Parquet partitioned by sequence, level (by length) and bin (of the start). Each stands once, however long it is."""
    level = level_of(TABLE_POWERS)
    bins = F.element_at(F.array(*[F.shiftright("start", p) for p in TABLE_POWERS]), F.col("level") + 1)
    dealt = recs.withColumn("level", level).withColumn("bin", bins)
    dealt.repartition("seqname", "level", "bin").sortWithinPartitions("seqname", "level", "bin", "start").write.mode("overwrite").partitionBy("seqname", "level", "bin").parquet(path)


def regions_of_binned(spark: SparkSession, path: str, schema: str, regions: DataFrame) -> DataFrame:
    """As overlapping_regions, from a table of write_binned. A record of a level is shorter than its bins, so a region names the bin before its start to that of its end, and Spark
    prunes the partitions that no region names when it has read the regions."""
    table = spark.read.schema(f"{schema}, seqname string, level int, bin long").parquet(path)
    used = store(table.select("seqname", "level", "bin").distinct(), "bins")
    own = regions.where("`end` >= start").select("region_id", "seqname", F.col("start").alias("region_start"), F.col("end").alias("region_end"))
    named = []
    for r in used.select("level").distinct().collect():
        k = r["level"]
        low, high = F.shiftright("region_start", TABLE_POWERS[k]) - 1, F.shiftright("region_end", TABLE_POWERS[k])
        wide = high - low > MOST_BINS
        narrow = own.where(~wide).withColumn("level", F.lit(k)).withColumn("bin", F.explode(F.sequence(low, F.least(high, low + MOST_BINS))))
        met = own.where(wide).join(used.where(F.col("level") == k), "seqname").where(F.col("bin").between(low, high))
        named.append(narrow.unionByName(met.select(*narrow.columns)))
    if not named:
        return table.join(own, "seqname").drop("level", "bin")  # an empty table
    asked = named[0]
    for n in named[1:]:
        asked = asked.unionByName(n)
    asked = store(asked, "regions")
    small = asked.where("region_end >= region_start")
    return table.join(F.broadcast(small) if asked.count() <= FEW else small, ["seqname", "level", "bin"]).where("start <= region_end and `end` >= region_start").drop("level", "bin")
