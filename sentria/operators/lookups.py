"""Joins that are no equality: cells in covers of mixed resolutions, and moments in intervals.

Both go by levels. What covers more is put on a level that suits its size; what
is looked up gets one key for each level that occurs. An equi-join of these keys
follows, which shuffles, spills and splits skewed keys like any other, and never
compares all with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import h3bits


def _levels(rows: DataFrame, level: Column) -> list[int]:
    """The levels that occur: 16 resolutions, or 63 lengths, at most."""
    return sorted(r[0] for r in rows.select(level.alias("level")).filter("level is not null").distinct().collect())


def _clash(left: DataFrame, right: DataFrame, on: list[str]) -> None:
    both = ({c.lower() for c in left.columns} & {c.lower() for c in right.columns}) - {c.lower() for c in on}
    if both:
        raise ValueError(f"columns of both sides: {sorted(both)}")


def in_covers(positions: DataFrame, covers: DataFrame, cell: str = "cell", cover_cell: str = "cover_cell", on: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both sides where ``cover_cell`` is the cell or holds it, and ``on`` agrees.

    A cover's cells may have any mix of resolutions. Cells of a cover that hold each other meet a position once each;
    ``outermost`` leaves one of them. A position's cell that is coarser than a cover's is not in it; null is in none.
    """
    _clash(positions, covers, list(on))
    levels = _levels(covers, h3bits.resolution(F.col(cover_cell)))
    if not levels:
        return positions.join(covers, list(on) or F.lit(False)).limit(0)
    above = F.filter(F.array(*(h3bits.parent(F.col(cell), r) for r in levels)), lambda c: c.isNotNull())
    return positions.withColumn(cover_cell, F.explode(above)).join(covers, [cover_cell, *on])


def outermost(covers: DataFrame, on: tuple[str, ...], cover_cell: str = "cover_cell") -> DataFrame:
    """``covers`` without the cells that another one of the same ``on`` holds, each cell once."""
    cells = covers.select(*on, cover_cell).distinct()
    inner = cells.withColumn("inner_cell", F.col(cover_cell)).drop(cover_cell)
    held = in_covers(inner, cells, "inner_cell", cover_cell, on).filter(F.col("inner_cell") != F.col(cover_cell)).select(*on, F.col("inner_cell").alias(cover_cell)).distinct()
    return covers.dropDuplicates([*on, cover_cell]).join(held, [*on, cover_cell], "left_anti")


#: Intervals shorter than 2**LEAST units share a level.
LEAST = 20


def at_times(moments: DataFrame, intervals: DataFrame, at: str, start: str, end: str, on: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both sides where ``start <= at <= end`` and ``on`` agrees; all three are longs, such as microseconds.

    An interval goes to the level whose buckets are at least as long as it is, hence to two
    of them at most, whatever its length; a moment lies in one bucket of each level. So a
    pair meets once. Nulls, and intervals that end before they start, meet nothing.
    """
    _clash(moments, intervals, list(on))
    length = F.col(end) - F.col(start)
    # the number of bits of a length: 2 ** bits exceeds it
    sized = intervals.filter(length >= 0).withColumn("_level", F.greatest(F.length(F.bin(length)), F.lit(LEAST)))
    levels = _levels(sized, F.col("_level"))
    if not levels:
        return moments.join(intervals, list(on) or F.lit(False)).limit(0)
    bucket = lambda time, level: F.call_function("shiftright", time, level)
    spread = sized.withColumn("_bucket", F.explode(F.array_distinct(F.array(bucket(F.col(start), F.col("_level")), bucket(F.col(end), F.col("_level"))))))
    each = F.array(*(F.struct(F.lit(level).alias("_level"), bucket(F.col(at), F.lit(level)).alias("_bucket")) for level in levels))
    keyed = moments.filter(F.col(at).isNotNull()).select("*", F.inline(each))
    return keyed.join(spread, [*on, "_level", "_bucket"]).filter(F.col(at).between(F.col(start), F.col(end))).drop("_level", "_bucket")
