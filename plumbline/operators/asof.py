"""As-of join: each left row with the latest right row of its key at or before its time."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.names import all_named, named
from ..functions.times import micros
from .skew import chunk_window, earlier_chunks, hot_keys, renamed, same, with_chunks


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    by: Sequence[str],
    right_on: str | None = None,
    how: str = "inner",
) -> DataFrame:
    """No pairs are formed. Without hot keys both sides go through one exchange by key, and along each key's
    times the last right row is carried to the left rows. With hot keys both sides are reduced to one row per key and instant, the last right
    row is carried forward along each key's instants, and every left row looks up its instant.
    Copies fold before the shuffle; a hot key is cut into ranges of time that are scanned
    apart, with the last right row of earlier ranges handed over in one summary row per range.
    Among right rows with equal key and time the greatest one (by its columns, in order) counts.
    """
    right_on = right_on or on
    by = list(by)
    payload = [c for c in right.columns if c not in by]
    renamed_payload = [c if c not in left.columns else f"{c}_right" for c in payload]

    rows = left.withColumn("_at", micros(named(on).cast("timestamp_ntz")))
    marks = right.select(
        *all_named(by),
        micros(named(right_on).cast("timestamp_ntz")).alias("_at"),
        F.struct(*[named(c).alias(r) for c, r in zip(payload, renamed_payload)]).alias("_r"),
    )
    whole = reduce(lambda a, b: a & b, [named(c).isNotNull() for c in [*by, "_at"]])
    places = rows.select(*all_named(by), "_at").unionByName(marks.select(*all_named(by), "_at")).where(whole)
    no_mark = F.lit(None).cast(marks.schema["_r"].dataType).alias("_r")
    hot = hot_keys(places, by)
    if hot is None:
        return _plain(rows, marks, by, whole, left.columns, renamed_payload, how)
    instants = (
        rows.select(*all_named(by), "_at", no_mark, F.lit(True).alias("_asked"))
        .unionByName(marks.select("*", F.lit(False).alias("_asked")))
        .where(whole)
        .groupBy(*all_named(by), "_at")
        .agg(F.max("_r").alias("_r"), F.max("_asked").alias("_asked"))
    )
    line, chunked = with_chunks(instants, by, "_at", places, hot)
    found = line.withColumn("_here", F.last("_r", ignorenulls=True).over(chunk_window(by, "_at"))).where("_asked")
    if chunked:
        # _asked is named so that both uses of the line need the same shuffle, which runs once
        carried = (
            line.where("_chunk > 0 and _asked is not null")
            .groupBy(*all_named(by), "_chunk")
            .agg(F.max(F.when(F.col("_r").isNotNull(), F.struct("_at", "_r"))).alias("_last"))
            .withColumn("_before", F.last("_last", ignorenulls=True).over(earlier_chunks(by))["_r"])
            .select(*all_named(by), "_chunk", "_before")
        )
        found = found.join(carried, [*by, "_chunk"], "left").withColumn("_here", F.coalesce("_here", "_before"))
    found = found.select(*renamed([*by, "_at"]), F.col("_here").alias("_r")).where(F.col("_r").isNotNull())

    keys = [*by, "_at"]
    copies = hot_keys(rows.select(*all_named(keys)), keys) if chunked else None
    if copies is None:
        joined = rows.join(found, same(keys), how)
    else:  # many left rows at one instant: they meet a broadcast of fewer than p answers
        names = copies.columns
        far = rows.join(F.broadcast(copies), same(keys), "left_anti").join(found, same(keys), how)
        answers = found.join(F.broadcast(copies), names, "left_semi")
        crowd = rows.join(F.broadcast(copies), same(keys), "left_semi")
        joined = far.unionByName(crowd.join(F.broadcast(answers), same(keys), how))
    return joined.select(*all_named(left.columns), *[F.col("_r")[r].alias(r) for r in renamed_payload])


def _plain(rows: DataFrame, marks: DataFrame, by: list[str], whole: Column, columns: list[str], payload: list[str], how: str) -> DataFrame:
    """Tag, union, one exchange by key, and a window that carries the last right row."""
    own = F.struct(*all_named(columns))
    none_left, none_right = (F.lit(None).cast(t) for t in (rows.select(own).schema[0].dataType, marks.schema["_r"].dataType))
    asked = rows.where(whole).select(*renamed(by), "_at", F.lit(1).alias("_side"), own.alias("_l"), none_right.alias("_r"))
    known = marks.where(whole).select(*renamed(by), "_at", F.lit(0).alias("_side"), none_left.alias("_l"), "_r")
    keys = [f"_k{i}" for i in range(len(by))]
    # at one time right rows stand first, the greatest last
    line = W.partitionBy(*keys).orderBy("_at", "_side", "_r").rowsBetween(W.unboundedPreceding, 0)
    found = asked.unionByName(known).withColumn("_r", F.last("_r", ignorenulls=True).over(line)).where("_side = 1")
    if how == "inner":
        found = found.where(F.col("_r").isNotNull())
    out = found.select(*[F.col("_l")[c].alias(c) for c in columns], *[F.col("_r")[r].alias(r) for r in payload])
    if how == "left":  # rows without a key or a time find nothing
        rest = rows.where(~whole).select(*all_named(columns), *[F.lit(None).cast(out.schema[r].dataType).alias(r) for r in payload])
        out = out.unionByName(rest)
    return out
