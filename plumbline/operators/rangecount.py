"""How many points fall into each interval, without pairing them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import all_named, named
from .skew import running_sum, with_chunks


def count_within(
    points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, key: str, by: Sequence[str]
) -> DataFrame:
    """(key, n): for each interval the points with equal `by` and low <= point <= high, whole
    numbers all; `key` is unique per interval. NULL equals nothing: such points count nowhere, such
    intervals, and empty ones, hold 0.

    Points and interval ends are laid on one line per `by` and points are counted along it: the
    count at the end of an interval less the count before its start. The work is one sort, even
    where every point lies in thousands of intervals.
    """
    by = list(by)
    whole = [named(c).isNotNull() for c in by]
    points = points.where(reduce(and_, [*whole, named(point).isNotNull()]))
    answered = reduce(and_, [*whole, named(low) <= named(high)])
    # intervals that hold nothing: empty, or without a bound or key
    nothing = intervals.where(~F.coalesce(answered, F.lit(False))).select(named(key).alias(key), F.lit(0).cast("bigint").alias("n"))
    intervals = intervals.where(answered)
    ends = [
        intervals.select(*all_named(by), (named(low) - 1).alias("_at"), F.lit(0).cast("bigint").alias("_p"), named(key).alias("_key"), F.lit(-1).alias("_sign")),
        intervals.select(*all_named(by), named(high).alias("_at"), F.lit(0).cast("bigint").alias("_p"), named(key).alias("_key"), F.lit(1).alias("_sign")),
    ]
    none = ends[0].schema["_key"].dataType
    # copies of a point fold into one count before the shuffle
    folded = points.groupBy(*all_named(by), named(point).alias("_at")).agg(F.count(F.lit(1)).alias("_p"))
    marks = folded.select(*all_named(by), "_at", "_p", F.lit(None).cast(none).alias("_key"), F.lit(0).alias("_sign"))
    places = intervals.select(*all_named(by), named(high).alias("_at")).unionByName(points.select(*all_named(by), named(point).alias("_at")))
    line, chunked = with_chunks(ends[0].unionByName(ends[1]).unionByName(marks), by, "_at", places)
    # at one place points count before the interval ends that include them
    counted = running_sum(line, chunked, by, "_p", "_at", F.col("_key").isNotNull()).where("_sign <> 0")
    held = counted.groupBy(F.col("_key").alias(key)).agg(F.sum(F.col("_sign") * F.col("_run")).alias("n"))
    return held.unionByName(nothing)
