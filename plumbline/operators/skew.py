"""Joins and ordered scans that hold when one key owns a large share of the rows.

A key is *hot* when it holds more than 1/p of all rows, p = shuffle partitions. There are
fewer than p such keys by arithmetic, so they may always be listed on the driver and broadcast.
They are looked for first, by a job over the key columns only that shuffles no key; where there are none, which is the
usual case, the plan that follows is the plain one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.names import all_named, named
from ..session import ensure_checkpoint_dir, shuffle_partitions

SKETCH_K = 2000  # a sketch's rank error is well below 1 / 1000


def _share(df: DataFrame) -> int:
    return shuffle_partitions(df.sparkSession)


def renamed(keys: Sequence[str]) -> list[Column]:
    return [named(k).alias(f"_k{i}") for i, k in enumerate(keys)]


def same(keys: Sequence[str]) -> Column:
    """Null-safe equality with the columns made by renamed()."""
    return reduce(
        lambda a, b: a & b, [named(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    )


def _heaviest(per_key: DataFrame, weight: str) -> tuple[list, bool]:
    """The hot rows of `per_key`, and whether they are all there are. Fewer than p rows come to
    the driver, by a top-k."""
    share = _share(per_key)
    seen = Observation()
    figures = per_key.observe(seen, F.sum(weight).alias("total"), F.count(F.lit(1)).alias("keys"))
    top = figures.orderBy(F.desc(weight)).limit(share).collect()
    total, keys = seen.get["total"] or 0, seen.get["keys"]
    if keys <= share:
        return top, True
    return [r for r in top if r[weight] * share > total], False


TRACKED = 16  # keys that a task's summary follows, by partition


def frequent_hashes(df: DataFrame, keys: Sequence[str]) -> tuple[list[int], int]:
    """(hashes of keys, rows): those of every key that holds more than 1/p of the rows, and few others.

    A frequent-items summary of bounded size (Misra and Gries) per task, merged: no key is shuffled. It follows 16 p keys, so it is off by less
    than a quarter of rows / p; no key it is to find can be missing, and fewer than 2 p are that large by its count.
    """
    share = _share(df)
    size = min(1_000_000, TRACKED * share)
    row = df.select(F.xxhash64(*all_named(keys)).alias("_h")).agg(F.expr(f"approx_top_k(_h, {min(2 * share, size)}, {size})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    return [item["item"] for item in row["top"] or [] if item["count"] * share > row["n"]], row["n"]


def hot_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """The keys that hold more than 1/p of the rows, renamed by renamed(); None if there are none.

    Candidates come from a summary; only their rows are counted, which folds them to fewer than 2 p keys in each task."""
    hashes, total = frequent_hashes(df, keys)
    if not hashes:
        return None
    sizes = df.where(F.xxhash64(*all_named(keys)).isin(hashes)).groupBy(*all_named(keys)).agg(F.count(F.lit(1)).alias("_n"))
    share = _share(df)
    hot = [tuple(r)[:-1] for r in sizes.where(F.col("_n") * share > total).collect()]
    if not hot:
        return None
    schema = T.StructType([T.StructField(f"_k{i}", df.schema[k].dataType) for i, k in enumerate(keys)])
    return df.sparkSession.createDataFrame(hot, schema)


def few_rows(per_key: DataFrame) -> DataFrame | None:
    """`per_key` as a local table if it has no more rows than partitions, else None. With a row per key it may then be broadcast."""
    share = _share(per_key)
    top = per_key.limit(share + 1).collect()
    return per_key.sparkSession.createDataFrame([tuple(r) for r in top], per_key.schema) if len(top) <= share else None


def split_join(left: DataFrame, per_key: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Inner, null-safe join of rows to one row per key; `weight` = rows of the key in `left`.

    The rows of hot keys, or all rows if there are no more keys than partitions, meet a
    broadcast of at most p rows and are never shuffled. The others take a shuffled join in which
    no key holds more than 1/p of the rows.
    """
    names = [c for c in per_key.columns if c not in keys]
    ensure_checkpoint_dir(left.sparkSession)
    # read twice: once for its heaviest rows, once for the join
    right = per_key.select(*renamed(keys), *names).checkpoint()
    key_names = [f"_k{i}" for i in range(len(keys))]
    top, complete = _heaviest(right, weight)
    near = F.broadcast(left.sparkSession.createDataFrame([tuple(r) for r in top], right.schema))
    joined = left.join(near, same(keys))
    if not complete:
        heavy = near.select(*key_names)
        if top:
            left = left.join(F.broadcast(heavy), same(keys), "left_anti")
            least = min(r[weight] for r in top)
            right = right.where(F.col(weight) < least)
        far = left.join(right, same(keys))
        joined = joined.unionByName(far) if top else far
    return joined.drop(*key_names)


def quantile_cuts(values: DataFrame, name: str, count: int) -> list[float]:
    """About evenly spaced quantiles of a column, `count` of them. Each task makes one sketch of a few KB,
    these are merged in p groups, and the p results in one."""
    number = F.col(name).cast("double")
    part = F.pmod(F.spark_partition_id(), F.lit(_share(values)))
    near = values.where(number.isNotNull()).select(number.alias("_x"), part.alias("_part"))
    merged = near.groupBy("_part").agg(F.kll_sketch_agg_double("_x", SKETCH_K).alias("_s")).agg(F.kll_merge_agg_double("_s").alias("_s"))
    grid = F.array(*[F.lit(i / (count + 1)) for i in range(1, count + 1)])
    row = merged.where("_s is not null").select(F.kll_sketch_get_quantile_double("_s", grid)).first()
    return row[0] if row else []


def range_index(value: Column, cuts: Column, steps: int) -> Column:
    """How many of the 2**steps - 1 ordered cuts are <= value, by binary search."""
    strides = F.array(*[F.lit(2**i) for i in reversed(range(steps))])
    return F.aggregate(
        strides,
        F.lit(0),
        lambda at, stride: F.when(F.element_at(cuts, at + stride) <= value, at + stride).otherwise(at),
    )


def with_chunks(df: DataFrame, by: Sequence[str], order: str, measure: DataFrame, hot: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """(df with `_chunk`, whether any chunk is used).

    `_chunk` is 0 for ordinary keys; for hot keys the number (from 1) of the row's range of
    `order` (a number), the ranges cut so that each holds about 1/p of the hot rows. Grouping or
    windowing by (by, _chunk) then never puts more than about 1/p of all rows in one task,
    and chunks of one key follow each other in `order`; rows without `order` come first.
    `measure` has the columns `by` and `order` of the same rows, from a plan that is cheap to run;
    `hot` are its hot keys, if known already.
    """
    hot = hot_keys(measure, by) if hot is None else hot
    if hot is None:
        return df.withColumn("_chunk", F.lit(0)), False
    steps = max(1, (_share(df) - 1).bit_length())
    cuts = quantile_cuts(measure.join(F.broadcast(hot), same(by), "left_semi"), order, 2**steps - 1)
    if not cuts:
        return df.withColumn("_chunk", F.lit(0)), False
    flagged = df.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), same(by), "left")
    at = F.coalesce(range_index(F.col(order), F.lit(cuts), steps), F.lit(0))
    chunk = F.when(F.col("_hot"), 1 + at).otherwise(0)
    return flagged.withColumn("_chunk", chunk).drop("_hot", *[f"_k{i}" for i in range(len(by))]), True


def chunk_window(by: Sequence[str], *order: Column | str):
    """Rows of one key within one chunk, from the first to the current one."""
    return W.partitionBy(*all_named(by), "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)


def earlier_chunks(by: Sequence[str]):
    """Summaries of the key's chunks before this one: at most 2p rows per key."""
    return W.partitionBy(*all_named(by)).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)


def running_sum(line: DataFrame, chunked: bool, by: Sequence[str], what: str, *order: Column | str) -> DataFrame:
    """Add `_run`: the sum of `what` along each key in `order`, over all its chunks."""
    local = line.withColumn("_run", F.sum(what).over(chunk_window(by, *order)))
    if not chunked:
        return local
    starts = (
        line.where("_chunk > 0")
        .groupBy(*all_named(by), "_chunk")
        .agg(F.sum(what).alias("_m"))
        .withColumn("_start", F.sum("_m").over(earlier_chunks(by)))
        .select(*renamed([*by, "_chunk"]), "_start")
    )
    joined = local.join(starts, same([*by, "_chunk"]), "left")
    return joined.withColumn("_run", F.col("_run") + F.coalesce("_start", F.lit(0))).select(*all_named(local.columns))
