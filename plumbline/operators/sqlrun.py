"""SQL over a dataset, in a session of its own; the dataset is the view `loaded_table`."""

from __future__ import annotations

import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.names import all_named, named, quoted

VIEW = "loaded_table"
PREVIEW_ROWS = 100
RECURSION_LEVELS = "100000"  # of a recursive query; its rows have a limit of their own


class QueryError(ValueError):
    """The text is empty, not valid SQL, or not a query."""


def run_sql(df: DataFrame, sql: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """The result of one Spark SQL query, not yet run.

    The query sees `loaded_table` and the other `tables` by name. It runs in a new session
    with this session's settings, where "name" quotes an identifier. Only queries are allowed:
    the text must be valid inside FROM ( ... ), which statements that change anything are not.
    """
    text = sql.strip().rstrip(";").strip()
    if not text:
        raise QueryError("empty query")
    spark = df.sparkSession
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            session.conf.set(key, value)
    session.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
    session.conf.set("spark.sql.cteRecursionLevelLimit", RECURSION_LEVELS)
    shared = []
    try:
        for name, table in {VIEW: df, **(tables or {})}.items():
            shared.append(f"v{uuid.uuid4().hex}")
            table.createOrReplaceGlobalTempView(shared[-1])
            session.table(f"global_temp.{shared[-1]}").createOrReplaceTempView(name)
        session.sql(f"SELECT * FROM (\n{text}\n) AS checked")
        return session.sql(text)
    except PySparkException as e:
        raise QueryError(str(e)) from e
    finally:
        for name in shared:  # the result is bound already; the shared names are no longer needed
            spark.catalog.dropGlobalTempView(name)


def preview_sql(table: str, columns: list[str], limit: int = PREVIEW_ROWS) -> str:
    names = ", ".join(quoted(c) for c in columns) or "*"
    return f"SELECT {names} FROM {quoted(table)} LIMIT {limit}"


def distinct_on(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key in the given order, which is made total by the other columns.

    A rank limit: each input partition passes on one row per key, so copies of a key are folded
    before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    rank = F.row_number().over(W.partitionBy(*all_named(keys)).orderBy(*all_named([*order, *rest])))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).select(*all_named(df.columns))
