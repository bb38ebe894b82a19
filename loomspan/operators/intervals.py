"""Joins of intervals that overlap, as equality joins of points with intervals in coordinate bins.

Two closed intervals overlap if and only if one holds the start of the other. So each side takes part twice: as intervals, each dealt to the bins that it covers, and as points (the starts), each
dealt to its own bin. Bins have several widths: an interval is dealt at the first level whose bins are wider than it is, to two or three of them, however long it is; a point is dealt
once at each level in use. A pair meets in exactly one of the two ways, and there in one bin.

Above the first level, where few long intervals meet many points in few bins, points are spread over SALTS keys and intervals are copied to each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Widths of bins, level by level, as powers of two; the last holds every difference of coordinates that is left.
POWERS = (14, 24, 34, 44, 54, 62)
LEVELS = tuple(range(len(POWERS)))
SALTS = 32


def level_of(powers: Sequence[int] = POWERS) -> Column:
    """The first level whose bins are wider than the interval (start, end); 0 for one that ends before it starts."""
    size = F.expr("try_subtract(`end`, start)")
    out = F.lit(len(powers) - 1)
    for k in reversed(range(len(powers) - 1)):
        out = F.when(size < F.lit(1 << powers[k]), k).otherwise(out)
    return F.when(F.col("end") < F.col("start"), 0).otherwise(out)


def levels_in(intervals: DataFrame) -> list[int]:
    """The levels at which intervals are dealt: at most one number for each of LEVELS."""
    return sorted(r["level"] for r in intervals.where("`end` >= start").select(level_of().alias("level")).distinct().collect())


def _cells(levels: Sequence[int], own: str, other: str) -> Column:
    """Places to which a row with `level` goes: as an interval (`own` names the way), and as a point at each of the levels (`other`)."""
    power = f"element_at(array({', '.join(map(str, POWERS))}), level + 1)"
    bins = f"sequence(shiftright(start, {power}), shiftright(greatest(start, `end`), {power}))"
    salts = f"if(level = 0, sequence(0, 0), sequence(0, {SALTS - 1}))"
    dealt = f"flatten(transform({bins}, b -> transform({salts}, s -> named_struct('level', level, 'bin', b, 'salt', s, 'way', '{own}'))))"
    salt = lambda k: f"cast(pmod(shiftright(start, {POWERS[0]}), {SALTS}) as int)" if k else "0"
    points = [f"named_struct('level', {k}, 'bin', shiftright(start, {POWERS[k]}), 'salt', {salt(k)}, 'way', '{other}')" for k in levels]
    return F.expr(f"concat(filter({dealt}, x -> `end` >= start), array({', '.join(points)}))" if points else f"filter({dealt}, x -> `end` >= start)")


def overlap_join(a: DataFrame, b: DataFrame, keys: Sequence[str], a_levels: Sequence[int] = LEVELS, b_levels: Sequence[int] = LEVELS) -> DataFrame:
    """Pairs of rows (each with keys, start, end and other columns) with equal keys whose closed intervals overlap: keys, and all other columns with a_ or b_ before the name.
    Each side is read once. Levels that no interval of a side has may be left out."""
    place = ["level", "bin", "salt", "way"]

    def dealt(side: DataFrame, levels: Sequence[int], own: str, other: str, name: str) -> DataFrame:
        rest = [c for c in side.columns if c not in keys]
        row = F.struct(*[F.col(c).alias(f"{name}_{c}") for c in rest]).alias("row")
        cells = side.withColumn("level", level_of()).select(*keys, row, F.explode(_cells(levels, own, other)).alias("cell"))
        return cells.select(*keys, *[f"cell.{c}" for c in place], "row.*")

    met = dealt(a, b_levels, "a", "b", "a").join(dealt(b, a_levels, "b", "a", "b"), [*keys, *place])
    once = "(way = 'a' and b_start >= a_start) or (way = 'b' and b_start < a_start)"
    return met.where(f"a_start <= b_end and b_start <= a_end and ({once})").drop(*place)
