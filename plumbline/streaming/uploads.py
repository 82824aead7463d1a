"""Uploads as a stream: each CSV file that arrives in a folder is checked and cleaned once.

Only operators that look at one row at a time run here, so the stream keeps no state.
"""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.clean import clean
from ..operators.validate import compile_rules
from ..sources.delimited import QUOTED
from ..sources.typing import tokens_to_null, typed_as

_RECORD = rf'(?:[^"\r\n]|{QUOTED})+'
_FIELD = rf',((?:[^",]|{QUOTED})*)'


def _fields(record: Column) -> Column:
    """The fields of a record; quotes around one are taken off, doubled ones inside become one."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_FIELD), F.lit(1))
    return F.transform(raw, lambda x: F.when(x.rlike(f"^{QUOTED}$"), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def follow_uploads(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Rows of the CSV files in `folder`, old and new, in the types of `schema`.

    An upload is one file of limited size and is read whole, so that its own header names its
    columns, in any order, and quotes may hold line breaks. Short rows are padded with NULL; an
    upload with other columns, or a row longer than the header, fails the stream.
    """
    uploads = spark.readStream.format("text").option("wholetext", True).load(folder)
    records = uploads.select(F.regexp_extract_all(F.regexp_replace("value", "^﻿", ""), F.lit(_RECORD), F.lit(0)).alias("records"))
    header = _fields(F.get("records", F.lit(0)))
    rows = records.select(header.alias("header"), F.explode(F.slice("records", 2, F.greatest(F.size("records") - 1, F.lit(0)))).alias("record"))
    parsed = rows.select("header", _fields(F.col("record")).alias("cells"))
    has_all = reduce(and_, [F.array_contains("header", f.name) for f in schema]) & (F.size("header") == len(schema))
    problem = F.when(~has_all, F.raise_error(F.concat(F.lit("an upload has other columns: "), F.array_join("header", ","))))
    problem = problem.when(F.size("cells") > F.size("header"), F.raise_error(F.lit("a row of an upload has more fields than its header")))
    checked = parsed.where(problem.cast("boolean").isNull())

    def cell(name: str) -> Column:
        return tokens_to_null(F.get("cells", (F.array_position("header", F.lit(name)) - 1).cast("int")))

    return checked.select(*[typed_as(cell(f.name), f.dataType).alias(f.name) for f in schema])


def clean_stream(rows: DataFrame, rules: dict[str, Any], normalize_case: str | None = None) -> DataFrame:
    """Cleaned rows with `failed`: the messages of the row-level rules each row breaks."""
    cleaned = clean(rows, normalize_case=normalize_case)
    marks = [
        F.when(c.bad, F.concat_ws(": ", F.lit(c.column), F.lit(c.message)))
        for c in compile_rules(cleaned, rules)
        if c.bad is not None
    ]
    failed = F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>")
    return cleaned.withColumn("failed", failed)


def write_uploads(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet what has arrived so far; `checkpoint` must be on shared storage."""
    return (
        rows.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
