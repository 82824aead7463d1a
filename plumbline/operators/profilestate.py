"""Profiles that grow with their table: a state per part (a file, a day), stored, and merged when asked for.

A state is one row per column: counts, extremes, moments and two sketches of fixed size, all of which merge. So new files cost a scan of the
new files only, and no task ever holds more than the sketches of one column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import named
from ..functions.text import is_numeric_type, nan_to_null, number_of, present
from ..session import shuffle_partitions
from .skew import SKETCH_K

DISTINCT_BITS = 14  # of an HLL sketch: 16 KB, an error of about 0.8 %
COLUMNS_PER_PASS = 40


def profile_state(df: DataFrame) -> DataFrame:
    """One row per column of `df`, in one scan for each 40 columns: position, name, type, rows, nulls, least and most (as text), total, middle
    (the mean), squares (about it), quantiles and distinct (sketches)."""
    out = None
    for at in range(0, len(df.columns), COLUMNS_PER_PASS):
        figures, rows, none = [F.count(F.lit(1)).alias("n")], [], F.lit(None)
        for i, name in enumerate(df.columns[at : at + COLUMNS_PER_PASS], at):
            value, dtype = present(df, name), df.schema[name].dataType
            numeric = is_numeric_type(dtype)
            figures += [F.count(value).alias(f"c{i}"), F.min(value).cast("string").alias(f"l{i}"), F.max(value).cast("string").alias(f"m{i}")]
            # values are hashed, so that their length does not matter; the hash of NULL would be one
            figures.append(F.hll_sketch_agg(F.when(value.isNotNull(), F.xxhash64(value)), DISTINCT_BITS).alias(f"d{i}"))
            if numeric:
                v = number_of(df, name)
                figures += [F.sum(v).alias(f"t{i}"), F.avg(v).alias(f"a{i}"), (F.var_pop(v) * F.count(v)).alias(f"s{i}"), F.kll_sketch_agg_double(v, SKETCH_K).alias(f"q{i}")]
            total, mean, squares, sketch = (F.col(f"{k}{i}") if numeric else none.cast(t) for k, t in (("t", "double"), ("a", "double"), ("s", "double"), ("q", "binary")))
            rows.append(
                F.struct(
                    F.lit(i).alias("position"), F.lit(name).alias("name"), F.lit(dtype.simpleString()).alias("type"), F.col("n").alias("rows"), (F.col("n") - F.col(f"c{i}")).alias("nulls"),
                    F.col(f"l{i}").alias("least"), F.col(f"m{i}").alias("most"), total.alias("total"), mean.alias("middle"), squares.alias("squares"), sketch.alias("quantiles"),
                    F.when(F.col(f"c{i}") > 0, F.col(f"d{i}")).alias("distinct"),
                )
            )
        part = df.agg(*figures).select(F.inline(F.array(*rows)))
        out = part if out is None else out.unionByName(part)
    return out


def merge_states(states: DataFrame) -> DataFrame:
    """One state of the rows that all `states` (united) describe, in two steps: many files' sketches of a column never meet in one task."""
    valued = F.col("rows") - F.col("nulls")
    weight = F.sum(F.when(F.col("middle").isNotNull(), valued))
    whole = states.groupBy("position").agg((F.sum(F.col("middle") * valued) / weight).alias("whole"))
    # every part's squares about the mean of all, so that merging is adding
    moved = states.join(F.broadcast(whole), "position")  # a row per column
    moved = moved.withColumn("squares", F.col("squares") + valued * (F.col("middle") - F.col("whole")) ** 2).withColumn("middle", F.col("whole")).drop("whole")
    salted = moved.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(shuffle_partitions(states.sparkSession))))
    return _added(_added(salted, ["part"]), [])


def _added(states: DataFrame, more: list[str]) -> DataFrame:
    numeric = F.col("type").rlike("^(tinyint|smallint|int|bigint|float|double|decimal.*)$")

    def outermost(column: str, by, among) -> Column:
        number = F.when(numeric, F.col(column).cast("double"))
        return F.coalesce(by(F.col(column), number), among(F.when(~numeric, F.col(column)))).alias(column)

    def sketch(column: str, merge) -> Column:  # merging nothing would make an empty sketch of another size
        return F.when(F.count(column) > 0, merge(column)).alias(column)

    return states.groupBy("position", "name", "type", *more).agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), outermost("least", F.min_by, F.min), outermost("most", F.max_by, F.max), F.sum("total").alias("total"),
        F.max("middle").alias("middle"), F.sum("squares").alias("squares"), sketch("quantiles", F.kll_merge_agg_double), sketch("distinct", F.hll_union_agg),
    ).drop(*more)


def profile_of(state: DataFrame) -> DataFrame:
    """name, type, rows, null_count, min, max, mean, std, q25, q50, q75 and approx_distinct of each column."""
    valued = F.col("rows") - F.col("nulls")
    quantiles = F.kll_sketch_get_quantile_double("quantiles", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    numeric = F.col("middle").isNotNull()
    shown = state.withColumn("_q", F.when(numeric, quantiles))
    return shown.select(
        "name", "type", "rows", F.col("nulls").alias("null_count"), F.col("least").alias("min"), F.col("most").alias("max"), nan_to_null(F.col("middle")).alias("mean"),
        F.when(valued > 1, nan_to_null(F.sqrt(F.col("squares") / (valued - 1)))).alias("std"), *[F.get("_q", F.lit(i)).alias(f"q{25 * (i + 1)}") for i in range(3)],
        F.coalesce(F.hll_sketch_estimate("distinct"), F.lit(0).cast("bigint")).alias("approx_distinct"),
    )
