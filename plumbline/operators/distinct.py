"""Exact distinct counts of integer columns by bitmaps, and duplicates of long values by their hashes first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import named

FEW = 1_000_000  # hashes of 8 bytes that may be broadcast


def exact_distinct(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, distinct: how many different non-null integers each column holds, for all columns from one scan.

    Values fall into buckets of 32,768 and set a bit in their bucket's bitmap, so each task passes on a bitmap of 4 KB at most
    per bucket it met, whatever the number of rows; nothing is expanded per column before the shuffle but a row's cells.
    """
    cells = [F.struct(F.lit(c).alias("column"), named(c).cast("bigint").alias("value")) for c in columns]
    values = df.select(F.inline(F.array(*cells))).where("value is not null")
    bitmaps = values.groupBy("column", F.bitmap_bucket_number("value").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("value")).alias("bits"))
    counted = bitmaps.groupBy("column").agg(F.sum(F.bitmap_count("bits")).alias("distinct"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "name string")
    found = names.join(counted, F.col("name") == F.col("column"), "left")  # a column of nulls has no bitmap
    return found.select(F.col("name").alias("column"), F.coalesce("distinct", F.lit(0).cast("bigint")).alias("distinct"))


def repeated_values(df: DataFrame, column: str, key: str) -> DataFrame:
    """key and n of every row whose non-null value occurs n > 1 times. Made for long values.

    The first pass counts 64-bit hashes, 16 bytes a row, folded in each task. Rows of hashes that occur once are done and never
    shuffled with their value; the values of the others are compared whole, so equal hashes of different values do no harm.
    """
    rows = df.where(named(column).isNotNull()).select(named(key).alias("_key"), named(column).alias("_value"), F.xxhash64(named(column)).alias("_hash"))
    repeated = rows.groupBy("_hash").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("_hash")
    few = repeated.limit(FEW + 1).count() <= FEW
    members = rows.join(F.broadcast(repeated) if few else repeated, "_hash", "left_semi")
    sizes = members.groupBy("_value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = members.select("_key", F.sha2(F.col("_value").cast("binary"), 256).alias("_digest"))
    counted = sizes.select(F.sha2(F.col("_value").cast("binary"), 256).alias("_digest"), "n")
    return met.join(counted, "_digest").select(F.col("_key").alias(key), "n")
