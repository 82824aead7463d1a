"""Profiling: counts, types, nulls and numeric statistics of every column."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import all_named, named
from ..functions.text import is_numeric_type, nan_to_null, number_of, present

COLUMNS_PER_PASS = 40  # keeps each aggregate inside the code generator's size limits
SAMPLE_ROWS = 20
RANDOM_ROWS = 50


def numeric_columns(df: DataFrame) -> list[str]:
    """Whole, fractional and boolean columns."""
    return [f.name for f in df.schema if is_numeric_type(f.dataType)]


def column_types(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema}


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("cols", F.lit(len(df.columns)))


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, null_count, null_pct, min, max, mean, std.

    All figures of up to 40 columns come from one aggregate over one scan that reads only
    these columns. Statistics are NULL for columns that are not numeric.
    """
    parts = [
        _profile_part(df, at, df.columns[at : at + COLUMNS_PER_PASS])
        for at in range(0, len(df.columns), COLUMNS_PER_PASS)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _profile_part(df: DataFrame, at: int, names: list[str]) -> DataFrame:
    figures, rows = [F.count(F.lit(1)).alias("n")], []
    for i, name in enumerate(names):
        figures.append(F.count_if(present(df, name).isNull()).alias(f"nulls{i}"))
        # after an infinite value a mean or deviation can be NaN, which is no figure
        stats = {"min": F.min, "max": F.max, "mean": lambda c: nan_to_null(F.avg(c)), "std": lambda c: nan_to_null(F.stddev_samp(c))}
        numeric = is_numeric_type(df.schema[name].dataType)
        if numeric:
            figures += [f(number_of(df, name)).alias(f"{k}{i}") for k, f in stats.items()]
        rows.append(
            F.struct(
                F.lit(at + i).alias("position"),
                F.lit(name).alias("name"),
                F.lit(df.schema[name].dataType.simpleString()).alias("type"),
                F.col(f"nulls{i}").alias("null_count"),
                (F.col(f"nulls{i}") / F.greatest(F.col("n"), F.lit(1))).alias("null_pct"),
                *[(F.col(f"{k}{i}") if numeric else F.lit(None).cast("double")).alias(k) for k in stats],
            )
        )
    return df.agg(*figures).select(F.inline(F.array(*rows)))


def display_profile(profile: DataFrame) -> DataFrame:
    """Add the forms shown to people: null percent with one decimal, mean with two."""
    return profile.withColumns(
        {"null_pct_shown": F.round(F.col("null_pct") * 100, 1), "mean_shown": F.round("mean", 2)}
    )


def first_rows(df: DataFrame, order_by: str | None = None, n: int = SAMPLE_ROWS) -> DataFrame:
    """The first n rows by a key; without one, n rows in reading order."""
    return (df.orderBy(named(order_by)) if order_by else df).limit(n)


def profile_dataset(df: DataFrame, order_by: str | None = None) -> dict[str, Any]:
    """The profile as {"row_count", "columns": [...], "sample_rows": [...]}: one entry per column
    and 20 rows are all that reaches the driver."""
    columns = []
    for r in column_profile(df).orderBy("position").collect():
        entry = {k: r[k] for k in ("name", "type", "null_count", "null_pct")}
        numeric = is_numeric_type(df.schema[r["name"]].dataType)
        columns.append({**entry, "stats": {k: r[k] for k in ("min", "max", "mean", "std")} if numeric else None})
    sample = [r.asDict() for r in first_rows(df, order_by).collect()]
    return {"row_count": df.count(), "columns": columns, "sample_rows": sample}


def random_rows(df: DataFrame, n: int = RANDOM_ROWS, seed: int = 0) -> DataFrame:
    """n rows, each equally likely, by the n smallest random numbers (no full sort)."""
    return df.orderBy(F.rand(seed)).limit(n)


def sample_by_key(df: DataFrame, key: str, n: int, by: Sequence[str] = (), weight: str | None = None, seed: str = "0") -> DataFrame:
    """n rows of the table, or of each group of `by`, with `chance`: those of the smallest keyed hashes.

    Which rows is decided by `seed` and the unique key alone, so no retry, partitioning or engine changes it, and samples of
    parts of a table merge by taking the smallest again. With `weight` a row's chance to come first is in proportion to
    it (Efraimidis and Spirakis 2006); rows without a positive weight are never taken. Each task passes on n rows a group.
    """
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), named(key).cast("string"))), 1, 13), 16, 10)
    even = (digits.cast("bigint") + 1) / F.lit(float(2**52))  # in (0, 1]
    chance = even if weight is None else F.when(named(weight) > 0, -F.log(even) / named(weight))
    rows = df.withColumn("chance", chance).where("chance is not null")
    if not by:
        return rows.orderBy("chance", named(key)).limit(n)
    place = F.row_number().over(Window.partitionBy(*all_named(by)).orderBy("chance", named(key)))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def summarize(df: DataFrame) -> DataFrame:
    """One row per column: min and max as text, approximate distinct count and quartiles,
    mean, deviation, count and null percentage."""
    parts = []
    for at in range(0, len(df.columns), COLUMNS_PER_PASS):
        parts.append(_summary_part(df, at, df.columns[at : at + COLUMNS_PER_PASS]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _summary_part(df: DataFrame, at: int, names: list[str]) -> DataFrame:
    figures, rows = [F.count(F.lit(1)).alias("n")], []
    none = F.lit(None).cast("double")
    for i, name in enumerate(names):
        dtype = df.schema[name].dataType
        c = present(df, name)
        figures += [
            F.min(c).cast("string").alias(f"min{i}"),
            F.max(c).cast("string").alias(f"max{i}"),
            F.approx_count_distinct(c).alias(f"distinct{i}"),
            F.count(c).alias(f"count{i}"),
        ]
        numeric = is_numeric_type(dtype)
        if numeric:
            v = number_of(df, name)
            figures += [
                nan_to_null(F.avg(v)).alias(f"avg{i}"),
                nan_to_null(F.stddev_samp(v)).alias(f"std{i}"),
                F.percentile_approx(v, [0.25, 0.5, 0.75]).alias(f"q{i}"),
            ]
        rows.append(
            F.struct(
                F.lit(at + i).alias("position"),
                F.lit(name).alias("column_name"),
                F.lit(dtype.simpleString()).alias("column_type"),
                F.col(f"min{i}").alias("min"),
                F.col(f"max{i}").alias("max"),
                F.col(f"distinct{i}").alias("approx_unique"),
                (F.col(f"avg{i}") if numeric else none).alias("avg"),
                (F.col(f"std{i}") if numeric else none).alias("std"),
                *[(F.get(f"q{i}", F.lit(j)) if numeric else none).alias(f"q{25 * (j + 1)}") for j in range(3)],
                F.col("n").alias("count"),
                (100 * (1 - F.col(f"count{i}") / F.greatest(F.col("n"), F.lit(1)))).alias("null_percentage"),
            )
        )
    return df.agg(*figures).select(F.inline(F.array(*rows)))
