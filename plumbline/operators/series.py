"""Time series: rows with both values, and resampling to calendar periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import all_named, named
from ..functions.text import number_of
from ..functions.times import FREQUENCIES, coerce_timestamp, truncate

MIN_POINTS = 8


def time_of(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        return coerce_timestamp(named(name))
    return named(name).cast("timestamp_ntz")


def series_points(df: DataFrame, ts: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """by..., ts, value: unparsable times and missing values dropped. Not sorted; see ordered()."""
    points = df.select(*all_named(by), time_of(df, ts).alias("ts"), number_of(df, value).alias("value"))
    return points.dropna(subset=["ts", "value"])


def ordered(points: DataFrame) -> DataFrame:
    return points.orderBy("ts")


def resample(
    df: DataFrame, ts: str, value: str, freq: str = "D", by: Sequence[str] = (), how: str = "sum"
) -> DataFrame:
    """One point per series and calendar period (D, W, M or Q): by..., ts (period start), value.

    After this a series has at most one point per period of the calendar, however many rows
    went in, so the methods that scan a series in time order have a bounded series each.
    """
    unit = FREQUENCIES[freq][0]
    fold = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}[how]
    points = series_points(df, ts, value, by)
    return points.groupBy(*all_named(by), truncate(unit, F.col("ts")).alias("ts")).agg(fold("value").cast("double").alias("value"))


def long_enough(points: DataFrame, by: Sequence[str] = (), least: int = MIN_POINTS) -> DataFrame:
    """by..., points of the series that have at least `least` of them."""
    return points.groupBy(*all_named(by)).agg(F.count(F.lit(1)).alias("points")).where(F.col("points") >= least)
