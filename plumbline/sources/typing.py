"""Column types from text: missing-value tokens, then one aggregate over all columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import named
from ..functions.text import is_number, strip, to_number

# Texts read as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Texts read as booleans.
TRUE_WORDS = ("True", "TRUE", "true")
FALSE_WORDS = ("False", "FALSE", "false")

COLUMNS_PER_PASS = 40  # five figures each: beyond about 200 the generated code gets too large


def tokens_to_null(c: Column) -> Column:
    return F.when(~c.isin(*NA_TOKENS), c)


def _whole_number(c: Column) -> Column:
    return strip(c).rlike(r"^[+-]?\d+$")


def infer_types(df: DataFrame) -> dict[str, str]:
    """bigint, double, boolean or string for each text column, from counts over all rows.

    Whole numbers beyond 64 bits keep their text. A column without any value is double.
    """
    types: dict[str, str] = {}
    for at in range(0, len(df.columns), COLUMNS_PER_PASS):
        part = df.columns[at : at + COLUMNS_PER_PASS]
        counts = []
        for i, name in enumerate(part):
            c = named(name)
            counts += [
                F.count(c).alias(f"n{i}"),
                F.count_if(_whole_number(c)).alias(f"w{i}"),
                F.count_if(_whole_number(c) & strip(c).try_cast("bigint").isNotNull()).alias(f"l{i}"),
                F.count_if(is_number(c)).alias(f"d{i}"),
                F.count_if(c.isin(*TRUE_WORDS, *FALSE_WORDS)).alias(f"b{i}"),
            ]
        row = df.agg(*counts).first()
        for i, name in enumerate(part):
            n, whole, fits, number, flag = (row[f"{k}{i}"] for k in "nwldb")
            if n and flag == n:
                types[name] = "boolean"
            elif whole == n and n:
                types[name] = "bigint" if fits == n else "string"
            elif number == n:
                types[name] = "double"
            else:
                types[name] = "string"
    return types


def typed_as(c: Column, dtype: T.DataType) -> Column:
    """Text in a given type; what the type's texts do not allow is NULL (Java's `1d` is no number)."""
    if isinstance(dtype, T.IntegralType):
        return F.when(_whole_number(c), strip(c).try_cast(dtype))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return to_number(c).cast(dtype)
    if isinstance(dtype, T.BooleanType):
        return F.when(c.isin(*TRUE_WORDS), True).when(c.isin(*FALSE_WORDS), False)
    return c.try_cast(dtype)


def cast_text(df: DataFrame, types: dict[str, str]) -> DataFrame:
    def typed(name: str) -> Column:
        c, kind = named(name), types[name]
        if kind == "bigint":
            c = strip(c).cast("bigint")
        elif kind == "double":
            c = to_number(c)
        elif kind == "boolean":
            c = c.isin(*TRUE_WORDS)
        return c.alias(name)

    return df.select(*[typed(name) for name in df.columns])


def unique_names(raw: list[str | None]) -> list[str]:
    """Header cells to column names: blanks are numbered, repeats get .1, .2, ..."""
    names: list[str] = []
    taken: set[str] = set()  # Spark does not tell upper from lower case
    for i, cell in enumerate(raw):
        base = cell if cell else f"Unnamed: {i}"
        name, k = base, 0
        while name.lower() in taken:
            k += 1
            name = f"{base}.{k}"
        names.append(name)
        taken.add(name.lower())
    return names
