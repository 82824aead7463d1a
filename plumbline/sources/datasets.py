"""Reading by format, and named datasets: parsed once, kept as Parquet, opened by name."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .delimited import read_csv
from .workbook import read_xlsx


def read_table(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """A table from CSV, .xlsx or Parquet; without `fmt` the path's ending decides.

    A file of any other ending, .csv included, is taken as a workbook if it starts like a zip archive,
    else as CSV; only a given `fmt` is taken at its word. A file that cannot be read as its format is an error.
    """
    kind = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "xls":
        raise ValueError("legacy .xls workbooks are not supported; save them as .xlsx")
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "xlsx":
        return read_xlsx(spark, path, None if fmt else "*.xlsx")
    if fmt != "csv":
        start = spark.read.text(path).limit(1).first()
        if start and start["value"].startswith("PK\x03\x04"):
            return read_xlsx(spark, path, None)
    return read_csv(spark, path)


def register_dataset(df: DataFrame, name: str, path: str) -> DataFrame:
    """Write the table once and make it known as `name`; later calls read the Parquet copy."""
    df.write.mode("overwrite").parquet(path)
    stored = df.sparkSession.read.parquet(path)
    stored.createOrReplaceTempView(name)
    return stored


def open_dataset(spark: SparkSession, name: str) -> DataFrame:
    try:
        return spark.table(name)
    except AnalysisException as e:
        raise KeyError(f"no dataset named {name!r}; register it first") from e


def rows_per_file(df: DataFrame) -> DataFrame:
    """filename, size in bytes and rows of each file that a table read from files comes from."""
    files = df.select(F.col("_metadata.file_name").alias("filename"), F.col("_metadata.file_size").alias("size"))
    return files.groupBy("filename", "size").agg(F.count(F.lit(1)).alias("rows"))


def dataset_meta(spark: SparkSession, path: str) -> DataFrame:
    """filename and size in bytes of each file; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size")
    )
