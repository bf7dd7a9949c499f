"""Range joins by dyadic cells: points in intervals, spans that overlap.

An interval of whole numbers is the disjoint union of at most two cells of each power of two, as in a segment tree; a point lies in one cell of each size. Joined on (key, size,
cell), a point meets an interval in exactly one cell, so there is no pair to throw away, no pair twice, and an interval of any length is a few rows. Sizes go up to the
longest interval, which one aggregate finds. A cell that very many intervals share is a key like any other, which Spark splits where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def covering(low: Column, high: Column, sizes: int) -> Column:
    """Cells (size, cell) whose union is the whole numbers from low to before high."""

    def step(acc: Column, size: Column) -> Column:
        a, b, out = acc["a"], acc["b"], acc["out"]
        odd = lambda x: F.pmod(x, F.lit(2)) == 1
        left = F.when((a < b) & odd(a), F.array(F.struct(size.alias("size"), a.alias("cell")))).otherwise(none)
        a = F.when((a < b) & odd(a), a + 1).otherwise(a)
        right = F.when((a < b) & odd(b), F.array(F.struct(size.alias("size"), (b - 1).alias("cell")))).otherwise(none)
        b = F.when((a < b) & odd(b), b - 1).otherwise(b)
        return F.struct(F.shiftright(a, 1).alias("a"), F.shiftright(b, 1).alias("b"), F.concat(out, left, right).alias("out"))

    none = F.array().cast("array<struct<size:int,cell:bigint>>")
    start = F.struct(low.cast("long").alias("a"), high.cast("long").alias("b"), none.alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(sizes)), start, step, lambda acc: acc["out"])


def cells_of(point: Column, sizes: int) -> Column:
    """The cell of each size that holds a point."""
    return F.array(*[F.struct(F.lit(k).alias("size"), F.shiftright(point.cast("long"), k).alias("cell")) for k in range(sizes + 1)])


def points_in(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Every row of points with every row of intervals where low <= point < high and the columns `by`, which both have, are equal. A null low is without a beginning, a null
    high without an end; a null point lies nowhere, and neither does a null key. Other columns must have different names."""
    bounds = points.agg(F.min(point).alias("first"), F.max(point).alias("last")).first()
    first, last = (0, 0) if bounds[0] is None else (int(bounds[0]), int(bounds[1]))
    cut = intervals.withColumn("__a", F.greatest(F.coalesce(F.col(low).cast("long"), F.lit(first)), F.lit(first)) - first)
    cut = cut.withColumn("__b", F.least(F.coalesce(F.col(high).cast("long"), F.lit(last + 1)), F.lit(last + 1)) - first).filter("__a < __b")
    longest = cut.agg(F.max(F.col("__b") - F.col("__a"))).first()[0] or 1
    sizes = int(longest).bit_length()
    right = cut.withColumn("__c", F.explode(covering(F.col("__a"), F.col("__b"), sizes))).drop("__a", "__b")
    left = points.filter(F.col(point).isNotNull()).withColumn("__d", F.explode(cells_of(F.col(point).cast("long") - first, sizes)))
    left = left.select([F.col(c).alias(f"__k{by.index(c)}") if c in by else F.col(c) for c in points.columns] + ["__d"])
    same = (F.col("__c.size") == F.col("__d.size")) & (F.col("__c.cell") == F.col("__d.cell"))
    for k, c in enumerate(by):
        same &= F.col(f"__k{k}") == F.col(c)
    return left.join(right, same).drop("__c", "__d", *(f"__k{k}" for k in range(len(by))))


def overlapping(a: DataFrame, b: DataFrame, a_low: str, a_high: str, b_low: str, b_high: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Every row of a with every row of b that it shares a whole number with: a begins in b, or b begins in a after a's beginning. Spans have both ends; empty ones overlap
    nothing."""
    a, b = a.filter(F.col(a_low) < F.col(a_high)), b.filter(F.col(b_low) < F.col(b_high))
    starts = points_in(a, b, a_low, b_low, b_high, by)
    later = points_in(b, a.withColumn("__after", F.col(a_low) + 1), b_low, "__after", a_high, by).drop("__after")
    return starts.unionByName(later.select(starts.columns))


def on_grid(low: Column, high: Column, size: Column, step: int, width: int) -> Column:
    """Beginnings of the windows [c, min(c + width, size)), c = 0, step, 2 step, ... below size, that a span low <= x < high shares a number with, as an array: windows on a grid
    are counted, not joined. An empty span is in none."""
    first = F.greatest(F.floor((low - width) / step) + 1, F.lit(0))
    last = F.floor((F.least(high, size) - 1) / step)
    none = F.array().cast("array<bigint>")
    return F.when((low < F.least(high, size)) & (first <= last), F.transform(F.sequence(first, F.greatest(first, last)), lambda c: c * step)).otherwise(none)
