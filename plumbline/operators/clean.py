"""Cleaning: trim, case, de-duplication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import named
from ..functions.text import lower_case, strip, upper_case


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def _on_strings(df: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    texts = set(string_columns(df))
    return df.select(*[(change(named(c)).alias(c) if c in texts else named(c)) for c in df.columns])


def trim_strings(df: DataFrame) -> DataFrame:
    return _on_strings(df, strip)


def lower_strings(df: DataFrame) -> DataFrame:
    return _on_strings(df, lower_case)


def upper_strings(df: DataFrame) -> DataFrame:
    return _on_strings(df, upper_case)


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Whole-row duplicates, missing equal to missing. A grouping by all columns, so copies are
    folded before the shuffle however many there are."""
    return df.dropDuplicates()


def clean(
    df: DataFrame, trim: bool = True, normalize_case: str | None = None, drop_duplicates: bool = False
) -> DataFrame:
    """Trim, then case ('lower' or 'upper', anything else is ignored), then duplicates."""
    if trim:
        df = trim_strings(df)
    if normalize_case == "lower":
        df = lower_strings(df)
    elif normalize_case == "upper":
        df = upper_strings(df)
    return drop_duplicate_rows(df) if drop_duplicates else df


def clean_observed(df: DataFrame, **options) -> tuple[DataFrame, Observation, Observation]:
    """clean() with the row counts before and after, known once the result has been written."""
    before, after = Observation(), Observation()
    counted = df.observe(before, F.count(F.lit(1)).alias("rows"))
    return clean(counted, **options).observe(after, F.count(F.lit(1)).alias("rows")), before, after


def clean_counts(df: DataFrame, **options) -> DataFrame:
    """One row: the row count before and after cleaning."""
    rows = F.count(F.lit(1))
    after = clean(df, **options).agg(rows).scalar()
    return df.agg(rows.alias("before")).select("before", after.alias("after"))
