"""Range join: points with the intervals that hold them, by a hierarchy of bins instead of all pairs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import all_named, named
from ..session import shuffle_partitions
from .skew import hot_keys, same

ENDS = -1  # the level of the bins that an interval begins and ends in
NEIGHBOURS = 10  # 2**10 bins are summed together


def range_join(
    points: DataFrame,
    intervals: DataFrame,
    point: Column,
    low: Column,
    high: Column,
    width: float,
    by: Sequence[str] = (),
    sums: Sequence[str] = (),
) -> DataFrame:
    """Rows with low <= point <= high and equal `by`; point, low and high are numbers.

    Bins of `width` are the leaves of a binary hierarchy; a node of level l is 2**l of them. An interval is copied to the nodes that
    cover its bins, at most two a level, however long it is (an end may be infinite); a point goes to its own node of each level that
    some interval uses, at most 62. They are joined on (by, level, node), so a key that owns many rows is spread over its
    nodes, and a pair meets once. Choose `width` near the length of the short intervals. A node that is hot, by
    its points or its intervals, is spread over a grid of about p cells; each side is copied
    along one edge of it, about sqrt(p) times.

    With `sums`, number columns of the points of which only the sums are asked for, no pairs are made: points are summed by node, and an
    interval meets each node that lies whole in it as one row of sums, and the points of the two bins that it begins and ends in folded by
    their place. The rows have the intervals' columns and `sums`; summed by interval they give the sums over its points. There are
    at most about 2 log2(bins that the points span) of them for an interval, besides the places in its two bins.
    """
    far = 1 << 61

    def bin_of(c: Column) -> Column:
        return F.floor(F.least(F.greatest(c / F.lit(width), F.lit(-float(far))), F.lit(float(far)))).cast("bigint")

    def covering(low_bin: Column, end_bin: Column) -> Column:
        """Nodes that cover the bins from low_bin up to, not with, end_bin: at each level the odd ends."""

        def of_level(level: Column) -> Column:
            first = -F.call_function("shiftright", -low_bin, level)  # the first node that begins in the interval
            end = F.call_function("shiftright", end_bin, level)
            odd = [F.when((first < end) & (F.pmod(first, F.lit(2)) == 1), first), F.when((first < end) & (F.pmod(end, F.lit(2)) == 1), end - 1)]
            return F.transform(F.array_compact(F.array(*odd)), lambda node: F.struct(level.alias("_level"), node.alias("_bin")))

        levels = F.sequence(F.lit(0), F.floor(F.log2(end_bin - low_bin)).cast("int"))
        return F.flatten(F.transform(levels, of_level))

    def at_levels(levels: Sequence[int]) -> list[Column]:
        """Of a point's bin, its node of each level."""
        nodes = [F.struct(F.lit(n).alias("_level"), F.shiftright("_leaf", n).alias("_bin")) for n in sorted(levels)]
        return nodes or [F.struct(F.lit(0).alias("_level"), F.col("_leaf").alias("_bin"))]

    keys = [*by, "_level", "_bin"]
    right = intervals.select("*", low.cast("double").alias("_lo"), high.cast("double").alias("_hi")).where("_lo <= _hi")
    left = points.select("*", point.cast("double").alias("_p"), bin_of(point).alias("_leaf")).where("_p is not null")
    if sums:
        span = left.agg(F.min("_leaf").alias("least"), F.max("_leaf").alias("most")).first()
        least, most = span["least"] or 0, span["most"] or 0
        # bins beyond all points need no nodes; a bin where an interval begins or ends (level -1) may hold points that it does not
        right = right.withColumn("_a", F.greatest(bin_of(F.col("_lo")), F.lit(least - 1))).withColumn("_b", F.least(bin_of(F.col("_hi")), F.lit(most + 1))).where("_a <= _b")
        ends = F.transform(F.array_distinct(F.array("_a", "_b")), lambda b: F.struct(F.lit(ENDS).alias("_level"), b.alias("_bin")))
        within = F.when(F.col("_b") - F.col("_a") > 1, covering(F.col("_a") + 1, F.col("_b"))).otherwise(F.array())
        right = right.select("*", F.inline(F.concat(ends, within))).drop("_a", "_b")
    else:
        right = right.select("*", F.inline(covering(bin_of(F.col("_lo")), bin_of(F.col("_hi")) + 1)))
    levels = [r[0] for r in right.select("_level").distinct().collect()]  # 63 at most
    if sums:
        levels = [n for n in levels if n != ENDS]
        totals = [F.sum(named(c)).alias(c) for c in sums]
        measured = left.select(*all_named(by), F.lit(ENDS).alias("_level"), F.col("_leaf").alias("_bin"))
        places = left.groupBy(*all_named(by), F.lit(ENDS).alias("_level"), F.col("_leaf").alias("_bin"), "_p").agg(*totals)
        bins = left.groupBy(*all_named(by), "_leaf").agg(*totals)
        # neighbouring bins in one task, so their sums by node are small before they are shuffled
        near = bins.repartition(shuffle_partitions(points.sparkSession), *all_named(by), F.shiftright("_leaf", NEIGHBOURS))
        nodes = near.select(*all_named(by), *all_named(sums), F.inline(F.array(*at_levels(levels)))).groupBy(*all_named(keys)).agg(*totals)
        names = [*by, *sums, "_p", "_level", "_bin"]
        left = places.select(*all_named(names)).unionByName(nodes.withColumn("_p", F.lit(None).cast("double")).select(*all_named(names)))
        left_names = [*by, *sums, "_p"]
    else:
        left = left.select("*", F.inline(F.array(*at_levels(levels)))).drop("_leaf")
        measured, left_names = left.select(*all_named(keys)), points.columns
    hot = hot_keys(measured.unionByName(right.select(*all_named(keys))), keys)
    if hot is not None:
        # a hot bin is a grid: a point has a row of its own and goes to all columns, an interval the reverse
        side = math.isqrt(shuffle_partitions(points.sparkSession)) + 1
        marked = F.broadcast(hot.withColumn("_hot", F.lit(True)))
        every = F.sequence(F.lit(0), F.when(F.col("_hot"), side - 1).otherwise(0))

        def spread(df: DataFrame, names: Sequence[str], own: str, others: str) -> DataFrame:
            place = F.pmod(F.xxhash64(*all_named(names)), F.lit(side)).cast("int")
            placed = df.join(marked, same(keys), "left").withColumn(own, F.when(F.col("_hot"), place).otherwise(0))
            return placed.withColumn(others, F.explode(every)).drop("_hot", *hot.columns)

        left, right = spread(left, left_names, "_row", "_column"), spread(right, intervals.columns, "_column", "_row")
        keys += ["_row", "_column"]
    met = left.join(right, keys).where("_p between _lo and _hi" if not sums else f"_level <> {ENDS} or _p between _lo and _hi")
    return met.drop("_p", "_lo", "_hi", "_level", "_bin", "_row", "_column")
