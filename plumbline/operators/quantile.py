"""Exact, linearly interpolated quantiles per group, without holding a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import all_named, named
from ..session import ensure_checkpoint_dir
from .skew import renamed, running_sum, same, with_chunks


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """One row per group: by..., n (rows) and one column per name in `probs`.

    Rows are folded to (group, value, count), each group's counts are summed along its values, and
    the values that hold the wanted ranks are picked. The values of a group that is too large for one task are
    cut into ranges, which are summed apart. The same way serves every size.
    """
    rows = df.where(named(value).isNotNull())
    keys = list(by) or ["_all"]
    if not by:
        rows = rows.withColumn("_all", F.lit(0))
    rows = rows.select(*all_named(keys), named(value).cast("double").alias("_v"))
    counted = rows.groupBy(*all_named(keys), "_v").agg(F.count(F.lit(1)).alias("_c"))
    ensure_checkpoint_dir(rows.sparkSession)
    counted = counted.checkpoint()  # read several times below
    totals = counted.groupBy(*all_named(keys)).agg(F.sum("_c").alias("n")).select(*renamed(keys), "n")
    line, chunked = with_chunks(counted, keys, "_v", counted)
    ranked = running_sum(line, chunked, keys, "_c", "_v").withColumnRenamed("_run", "_end")
    ranked = ranked.join(totals, same(keys)).drop(*[f"_k{i}" for i in range(len(keys))])

    def at_rank(rank: Column) -> Column:
        holds = (F.col("_end") > rank) & (F.col("_end") - F.col("_c") <= rank)
        return F.max(F.when(holds, F.col("_v")))

    ends = []
    for i, p in enumerate(probs.values()):
        place = F.lit(p) * (F.col("n") - 1)
        ends += [at_rank(F.floor(place)).alias(f"_low{i}"), at_rank(F.ceil(place)).alias(f"_high{i}")]
    found = ranked.groupBy(*all_named(keys), "n").agg(*ends)

    def quantile(i: int, p: float) -> Column:
        place, low, high = F.lit(p) * (F.col("n") - 1), F.col(f"_low{i}"), F.col(f"_high{i}")
        # equal ends stay as they are, infinite ones included
        return F.when(low == high, low).otherwise(low + (place - F.floor(place)) * (high - low))

    return found.select(*all_named(by), "n", *[quantile(i, p).alias(name) for i, (name, p) in enumerate(probs.items())])
