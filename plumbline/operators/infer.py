"""Column inference: which column is the date, which the value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import named
from ..functions.times import coerce_timestamp, day_first_votes, swap_day_and_month
from .clean import string_columns
from .profile import numeric_columns

# Column names taken as dates, in order of preference.
DATE_NAMES = ("date", "timestamp", "time", "datetime", "ds", "day", "month", "year")
ENOUGH = 0.7
COLUMNS_PER_PASS = 40


def date_fractions(df: DataFrame) -> DataFrame:
    """One row per text column: position, name, and the share of all rows that parse as a
    timestamp; `parses` = every non-null value does."""
    names = string_columns(df)
    out = None
    for at in range(0, len(names), COLUMNS_PER_PASS):
        figures, rows = [F.count(F.lit(1)).alias("n")], []
        for i, name in enumerate(names[at : at + COLUMNS_PER_PASS], at):
            figures += [F.count(named(name)).alias(f"v{i}"), F.count(coerce_timestamp(named(name))).alias(f"p{i}")]
            rows.append(
                F.struct(
                    F.lit(i).alias("position"),
                    F.lit(name).alias("name"),
                    (F.col(f"p{i}") / F.greatest(F.col("n"), F.lit(1))).alias("fraction"),
                    ((F.col(f"v{i}") == F.col(f"p{i}")) & (F.col(f"v{i}") > 0)).alias("parses"),
                )
            )
        part = df.agg(*figures).select(F.inline(F.array(*rows)))
        out = part if out is None else out.unionByName(part)
    if out is None:
        schema = "position int, name string, fraction double, parses boolean"
        return df.sparkSession.createDataFrame([], schema)
    return out


def coerce_timestamps(df: DataFrame, columns: list[str]) -> DataFrame:
    """`df` with these text columns as timestamps, each read by one layout of day and month.

    Whether 03/04/2024 is in March or April is for the column to say: the order that fits more of its values is that of all, the month
    first where both fit as many; values that do not fit it are NULL. All columns vote in one scan.
    """
    votes = [F.struct(*[v.alias(n) for n, v in zip(("day", "month"), day_first_votes(named(c)))]).alias(f"v{i}") for i, c in enumerate(columns)]
    voted = df.agg(F.struct(*votes)).scalar()
    swapped = {c: voted[f"v{i}"]["day"] > voted[f"v{i}"]["month"] for i, c in enumerate(columns)}
    turned = df.select(*[swap_day_and_month(named(c), swapped[c]).alias(c) if c in swapped else named(c) for c in df.columns])
    return turned.select(*[coerce_timestamp(named(c)).alias(c) if c in swapped else named(c) for c in df.columns])


def infer_date_col(df: DataFrame) -> str | None:
    """A timestamp-typed column; else a known name whose values all parse; else the first text
    column of which more than 70 % of the rows parse."""
    for f in df.schema:
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return f.name
    found = {r["name"]: r for r in date_fractions(df).collect()}
    for wanted in DATE_NAMES:
        for name, row in found.items():
            if name.lower() == wanted and row["parses"]:
                return name
    for name, row in found.items():
        if row["fraction"] > ENOUGH:
            return name
    return None


def infer_value_col(df: DataFrame) -> str | None:
    """The last numeric column."""
    numeric = numeric_columns(df)
    return numeric[-1] if numeric else None
