"""Parquet, CSV and catalog-table sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """With header; quotes inside values are doubled and empty text stays distinct from NULL."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", '""')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def load_table(df: DataFrame, table: str, fmt: str = "parquet", **options: str) -> dict:
    """Append to the table named `table` in capitals, creating it if needed.

    `fmt` and `options` name the warehouse's data source; the rows are counted while written.
    """
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.format(fmt).options(**options).mode("append").saveAsTable(table.upper())
    return {"success": True, "rows": seen.get["rows"]}
