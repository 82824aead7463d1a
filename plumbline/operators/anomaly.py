"""Anomaly detection with built-in aggregates and windows: z-score, IQR, moving average,
classic decomposition, generalised ESD; and the report forms of their results."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.names import all_named, named
from ..functions.student import esd_limits
from ..functions.text import nan_to_null, number_of
from ..functions.times import FREQUENCIES, iso_text
from ..session import ensure_checkpoint_dir, shuffle_partitions
from .quantile import exact_quantiles
from .series import MIN_POINTS
from .skew import SKETCH_K, few_rows, renamed, same, split_join

LIMIT = 3.0
FENCE = 1.5
WINDOW = 7


def _score(value: Column, mean: Column, std: Column) -> Column:
    """NULL where a figure is missing or NaN, as after an infinite value; in Spark NaN > 0 holds."""
    return F.when(nan_to_null(std) > 0, nan_to_null((value - mean) / std))


def zscore(df: DataFrame, value: str, by: Sequence[str] = (), limit: float = LIMIT) -> DataFrame:
    """Rows with |value - mean| / std > limit, with `score`; per table, or per group of `by`.

    Whole table: mean and deviation are a scalar subquery, so rows are only scanned and
    filtered. Per group: partial aggregates, joined back without shuffling hot groups.
    """
    rows = df.withColumn("_v", number_of(df, value))
    figures = [F.avg("_v").alias("_mean"), F.stddev_samp("_v").alias("_std")]
    if by:
        stats = rows.groupBy(*all_named(by)).agg(F.count(F.lit(1)).alias("_n"), *figures)
        scored = split_join(rows, stats, by, "_n").withColumn("score", _score(F.col("_v"), F.col("_mean"), F.col("_std")))
    else:
        stat = rows.agg(F.struct(*figures)).scalar()
        scored = rows.withColumn("score", _score(F.col("_v"), stat["_mean"], stat["_std"]))
    return scored.where(F.abs("score") > limit).select(*all_named(df.columns), "score")


def iqr(df: DataFrame, value: str, by: Sequence[str] = (), fence: float = FENCE, least: int = 1) -> DataFrame:
    """Rows outside [q1 - 1.5 iqr, q3 + 1.5 iqr], with the fences `low` and `high`, for groups of
    at least `least` values."""
    rows = df.withColumn("_v", number_of(df, value))
    quartiles = exact_quantiles(rows, "_v", {"_q1": 0.25, "_q3": 0.75}, by).where(F.col("n") >= least)
    span = F.lit(fence) * (F.col("_q3") - F.col("_q1"))
    fences = quartiles.select(*all_named(by), "n", nan_to_null(F.col("_q1") - span).alias("low"), nan_to_null(F.col("_q3") + span).alias("high"))
    if by:
        few, valued = few_rows(fences), rows.where("_v is not null")
        fenced = split_join(valued, fences, by, "n") if few is None else _near_join(valued, few, by)
    else:
        pair = fences.select(F.struct("low", "high")).scalar()
        fenced = rows.withColumns({"low": pair["low"], "high": pair["high"]})
    return fenced.where("_v < low or _v > high").select(*all_named(df.columns), "low", "high")


def _near_join(rows: DataFrame, few: DataFrame, by: Sequence[str]) -> DataFrame:
    """Null-safe join with at most a row per partition, by broadcast: rows are not shuffled."""
    names = [c for c in few.columns if c not in by]
    return rows.join(F.broadcast(few.select(*renamed(by), *names)), same(by)).drop(*[f"_k{i}" for i in range(len(by))])


def _series(by: Sequence[str]):
    """Window over one resampled series; its length is bounded by the calendar."""
    return W.partitionBy(*all_named(by))


def _flag_residuals(rows: DataFrame, by: Sequence[str], limit: float) -> DataFrame:
    """Keep points whose residual `_e` is more than `limit` deviations from its mean."""
    whole = _series(by)
    score = _score(F.col("_e"), F.avg("_e").over(whole), F.stddev_samp("_e").over(whole))
    scored = rows.withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("score", score)
    return scored.where((F.abs("score") > limit) & (F.col("_n") >= MIN_POINTS)).select(*all_named(by), "ts", "value", "score")


def moving_average(points: DataFrame, by: Sequence[str] = (), window: int = WINDOW, limit: float = LIMIT) -> DataFrame:
    """Points of a resampled series far from the trailing mean of `window` points (itself
    included)."""
    trailing = _series(by).orderBy("ts").rowsBetween(1 - window, 0)
    rows = points.withColumn("_e", F.col("value") - F.avg("value").over(trailing))
    return _flag_residuals(rows, by, limit)


# Frequency letter -> position of a period within its season.
PHASES = {"D": F.dayofweek, "W": F.weekofyear, "M": F.month, "Q": F.quarter}


def classic(points: DataFrame, freq: str = "D", by: Sequence[str] = (), limit: float = LIMIT) -> DataFrame:
    """Points of a resampled series that the centred moving-average trend and the mean
    seasonal figure per calendar phase do not explain."""
    m = FREQUENCIES[freq][2]
    series, line = _series(by), _series(by).orderBy("ts")

    def centred(first: int, last: int) -> Column:
        frame = line.rowsBetween(first, last)
        return F.when(F.count("value").over(frame) == last - first + 1, F.avg("value").over(frame))

    half = m // 2
    trend = centred(-half, half) if m % 2 else (centred(-half, half - 1) + centred(1 - half, half)) / 2
    phase = _series([*by, "_phase"])
    size = F.count("_d").over(phase)
    # the mean over phases of the phase means: each row carries 1/size of its phase
    share = F.when(F.col("_d").isNotNull(), 1 / F.col("_size"))
    rows = (
        points.withColumn("_phase", PHASES[freq]("ts"))
        .withColumn("_t", trend)
        .withColumn("_d", F.col("value") - F.col("_t"))
        .withColumns({"_size": F.nullif(size, F.lit(0)), "_figure": F.avg("_d").over(phase)})
        .withColumn("_share", share)
        .withColumn("_level", F.sum(F.col("_figure") * F.col("_share")).over(series) / F.nullif(F.sum("_share").over(series), F.lit(0)))
        .withColumn("_e", F.col("_d") - (F.col("_figure") - F.col("_level")))
    )
    return _flag_residuals(rows, by, limit)


def _sure_limit(n: Column, alpha: float) -> Column:
    """A number that no critical value of the ESD test on n values is below: that of the last removal, with a normal quantile a bit
    too small in the place of Student's."""
    left = n - F.floor(n / 10)
    twice = 2 * F.log(2 * (left + 1) / F.lit(alpha))
    z = F.sqrt(F.greatest(twice - F.log(twice) - F.log(F.lit(2 * math.pi)), F.lit(0.0))) - 0.05
    return left * z / F.sqrt((left - 1 + z * z) * (left + 1))


def _esd_marks(rows: DataFrame, names: Sequence[str], alpha: float, rounds: int) -> tuple[DataFrame, bool]:
    """Per series _n, _mean, _var, and _cut0 and _cut1: only values outside can be removed; after a round of narrowing, can be
    removed before the last significant removal.

    Removals never reach the values between a sketch's 12 % and 88 % quantiles (its error is a tenth of the margin). While those between the
    cuts all stay, a deviation is never below s0, that of them alone over all n, and a mean never outside (m0, m1), those of all values
    below and above one cut. A significant removal is D = limit * s0 from its mean at least; and what goes before it is as far out, but for
    a shift of the mean: all lie outside of m1 - D + (m1 - m0) and m0 + D - (m1 - m0). So these are cuts too, and the next round starts from them.
    Also returned: whether the series are so few that their figures are a local table.
    """
    sketch = rows.groupBy(*names).agg(F.kll_sketch_agg_double("_v", SKETCH_K).alias("_s"))
    cut = [F.kll_sketch_get_quantile_double("_s", F.lit(q)).alias(f"_cut{i}") for i, q in enumerate((0.12, 0.88))]
    cuts = sketch.select(*names, *cut)
    few = few_rows(cuts)
    marks = _esd_figures(rows, names, cuts if few is None else few, few is not None)
    for left in range(rounds - 1, -1, -1):
        marks = marks if few is None else few_rows(marks)
        far = _sure_limit(F.col("_n"), alpha) * F.sqrt(F.col("_squares") / (F.col("_n") - 1))
        shift = F.col("_m1") - F.col("_m0")
        ease = 1e-9 * (F.abs("_m0") + F.abs("_m1") + far)  # rounding must not decide
        low, high = nan_to_null(F.col("_m1") - far + shift + ease), nan_to_null(F.col("_m0") + far - shift - ease)
        # without a figure, or where the bounds cross, greatest and least fall back on the cuts before
        narrower = [F.when(low < high, F.least("_cut0", low)).otherwise(F.col("_cut0")), F.when(low < high, F.greatest("_cut1", high)).otherwise(F.col("_cut1"))]
        marks = marks.select(*names, "_n", "_mean", "_var", *[F.coalesce(c, F.col(f"_cut{i}")).alias(f"_cut{i}") for i, c in enumerate(narrower)])
        if left:
            marks = _esd_figures(rows, names, marks, few is not None)
    marks = marks.select(*names, "_n", "_mean", "_var", "_cut0", "_cut1")
    return marks if few is None else few_rows(marks), few is not None


def _with_cuts(rows: DataFrame, names: Sequence[str], cuts: DataFrame, few: bool) -> DataFrame:
    """Few series meet a broadcast; many take a join, whose hot keys adaptive execution splits."""
    if not names:
        pair = cuts.select(F.struct("_cut0", "_cut1")).scalar()
        return rows.withColumns({"_cut0": pair["_cut0"], "_cut1": pair["_cut1"]})
    cuts = cuts.select(*names, "_cut0", "_cut1")
    if few:
        return _near_join(rows, cuts, names)
    return rows.join(cuts.select(*renamed(names), "_cut0", "_cut1"), same(names)).drop(*[f"_k{i}" for i in range(len(names))])


def _esd_figures(rows: DataFrame, names: Sequence[str], cuts: DataFrame, few: bool) -> DataFrame:
    """The cuts with n, mean and variance, the sum of squares between them, and the means below and above one of them."""
    middle = F.when((F.col("_v") > F.col("_cut0")) & (F.col("_v") < F.col("_cut1")), F.col("_v"))
    below, above = F.when(F.col("_v") < F.col("_cut1"), F.col("_v")), F.when(F.col("_v") > F.col("_cut0"), F.col("_v"))
    return (
        _with_cuts(rows, names, cuts, few)
        .groupBy(*names)
        .agg(
            F.count("_v").alias("_n"), F.avg("_v").alias("_mean"), F.var_samp("_v").alias("_var"),
            F.first("_cut0").alias("_cut0"), F.first("_cut1").alias("_cut1"),
            (F.var_pop(middle) * F.count(middle)).alias("_squares"), F.avg(below).alias("_m0"), F.avg(above).alias("_m1"),
        )
    )


def esd_steps(df: DataFrame, value: str, by: Sequence[str] = (), alpha: float = 0.05, pruned: bool = False) -> DataFrame:
    """Steps of the generalised ESD test: by..., i, side (-1 low, 1 high), place (from that
    end, from 1), value, statistic, critical, for up to n // 10 removals of each series; if `pruned`, only as far as a
    removal can still be significant.

    A removal takes an end of the sorted values, so count, mean, variance and the values outside of two marks decide the test exactly. They
    are folded to value and count by executors; one task per series walks along both ends. A series is thus as much work there as it has
    different values beyond the marks: with `pruned` those that are far out, else a quarter of all.
    """
    names = [f"_g{i}" for i in range(len(by))]  # plain names for the Python step
    rows = df.select(*[named(c).alias(g) for c, g in zip(by, names)], number_of(df, value).alias("_v")).where("_v is not null")
    marks, few = _esd_marks(rows, names, alpha, 2 if pruned else 0)
    outside = F.when((F.col("_v") <= F.col("_cut0")) | (F.col("_v") >= F.col("_cut1")), F.col("_v"))
    # of what lies between, only the outermost two values
    ends = _with_cuts(rows, names, marks, few).groupBy(*names, outside.alias("_o")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    out = T.StructType([rows.schema[c] for c in names])
    for name, kind in (("i", "long"), ("side", "integer"), ("place", "long"), ("value", "double"), ("statistic", "double"), ("critical", "double")):
        out = out.add(name, kind)

    def rosner(frame: pd.DataFrame) -> pd.DataFrame:
        info = frame[frame["_n"].notna()].iloc[0]
        n, mean0, var = int(info["_n"]), info["_mean"], info["_var"]
        k = n // 10
        if n < MIN_POINTS or k < 1 or not var > 0 or not np.isfinite(var):
            return pd.DataFrame(columns=out.names, dtype=object)
        end = frame[frame["_o"].notna()].sort_values("_o")
        between = frame[frame["_n"].isna() & frame["_o"].isna()]
        values, left = end["_o"].to_numpy(), end["_c"].to_numpy().astype("int64")
        inner = between[["_least", "_most"]].to_numpy().ravel() if len(between) else np.array([])  # never removed
        split = int(np.searchsorted(values, inner[0])) if len(inner) else len(values)
        values = np.concatenate([values[:split], inner, values[split:]])
        left = np.concatenate([left[:split], np.zeros(len(inner), "int64"), left[split:]])
        x, low, high = values - mean0, 0, len(values) - 1
        total, squares, places, steps = 0.0, var * (n - 1), {-1: 0, 1: 0}, []
        for i in range(k):
            m = n - i
            mean = total / m
            spread = (squares - total * total / m) / (m - 1)
            if not spread > 0:
                break
            side = -1 if mean - x[low] > x[high] - mean else 1
            at = low if side < 0 else high
            if not left[at]:
                if not pruned:
                    raise ValueError(f"the sketch of a series of {n} values is too far off")
                break
            places[side] += 1
            steps.append((i + 1, side, places[side], values[at], abs(x[at] - mean) / np.sqrt(spread)))
            left[at] -= 1
            if not left[at]:
                low, high = (low + 1, high) if side < 0 else (low, high - 1)
            total, squares = total - x[at], squares - x[at] ** 2
        bounds = esd_limits(n, len(steps), alpha) if steps else ()
        return pd.DataFrame([(*s, b) for s, b in zip(steps, bounds)], columns=out.names[len(names) :]).assign(**{g: info[g] for g in names})[out.names]

    heads = marks.select(*names, *[F.lit(None).cast(ends.schema[c].dataType).alias(c) for c in ("_o", "_c", "_least", "_most")], "_n", "_mean", "_var")
    tails = ends.select(*names, "_o", "_c", "_least", "_most", *[F.lit(None).cast(heads.schema[c].dataType).alias(c) for c in ("_n", "_mean", "_var")])
    parts = heads.unionByName(tails)
    if names:  # few bytes per series, but work: keep the series in many tasks
        parts = parts.repartition(shuffle_partitions(df.sparkSession), *names)
    found = parts.groupBy(*names).applyInPandas(rosner, out)
    return found.select(*[F.col(g).alias(c) for c, g in zip(by, names)], *out.names[len(names) :])


def esd(df: DataFrame, value: str, key: str, by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Generalised ESD test per series for up to n // 10 outliers: by..., key, value, score (the test statistic).

    The outliers are all removals up to the last significant one. Of equal values those of the
    smallest keys are taken from the low end, of the largest keys from the high end.
    """
    names = [f"_g{i}" for i in range(len(by))]
    rows = df.select(*[named(c).alias(g) for c, g in zip(by, names)], named(key).alias("_key"), number_of(df, value).alias("_v")).where("_v is not null")
    plain = rows.select(*names, "_v")
    steps = esd_steps(plain, "_v", names, alpha, pruned=True)
    last = F.max(F.when(F.col("statistic") > F.col("critical"), F.col("i"))).over(W.partitionBy(*names))
    ensure_checkpoint_dir(df.sparkSession)
    outliers = steps.withColumn("_last", last).where(F.col("i") <= F.col("_last")).select(*names, "side", "place", F.col("value").alias("_o"), "statistic").checkpoint()
    values = outliers.groupBy(*names, "side", "_o").agg(F.count(F.lit(1)).alias("_c"))
    met = [F.col(f"r.{g}").eqNullSafe(F.col(f"o.{g}")) for g in names]
    joined = rows.alias("r").join(values.alias("o"), reduce(and_, [*met, F.col("r._v") == F.col("o._o")]))
    # the values before a place are outliers of that side too, so places count among these rows
    up = W.partitionBy("side", *names).orderBy("_v", "_key")
    down = W.partitionBy("side", *names).orderBy(F.desc("_v"), F.desc("_key"))
    sided = joined.select(*[f"r.{g}" for g in names], "_key", "_v", "side")
    place = F.when(F.col("side") < 0, F.row_number().over(up)).otherwise(F.row_number().over(down))
    placed = sided.withColumn("place", place.cast("bigint"))
    back = [F.col(f"p.{g}").eqNullSafe(F.col(f"o.{g}")) for g in names]
    found = placed.alias("p").join(outliers.alias("o"), reduce(and_, [*back, F.col("p.side") == F.col("o.side"), F.col("p.place") == F.col("o.place")]))
    return found.select(*[F.col(f"p.{g}").alias(c) for c, g in zip(by, names)], F.col("p._key").alias(key), F.col("p._v").alias(value), F.col("statistic").alias("score"))


def found_points(anomalies: DataFrame) -> DataFrame:
    """Without the rows that only report a series on which the method failed."""
    return anomalies.where("error is null") if anomalies.columns[-2:] == ["method", "error"] else anomalies


def summary(anomalies: DataFrame, method: str) -> DataFrame:
    """One row: count, method_used. Rows that report a failure are no anomalies."""
    return found_points(anomalies).agg(F.count(F.lit(1)).alias("count")).withColumn("method_used", F.lit(method))


# Fixed value: the narrative given when no model writes one.
NARRATIVE = "Analysis used method=%s. Found %d anomalies. Inspect flagged points for root cause."


def narrative(summary_row: DataFrame) -> DataFrame:
    return summary_row.select(F.format_string(NARRATIVE, "method_used", "count").alias("narrative"))


def anomaly_rows(anomalies: DataFrame, ts: str, value: str) -> DataFrame:
    """date (ISO text), value and row (all columns as JSON, timestamps as ISO text)."""
    times = (T.TimestampType, T.TimestampNTZType)
    cells = [
        (iso_text(named(f.name)) if isinstance(f.dataType, times) else named(f.name)).alias(f.name)
        for f in anomalies.schema
    ]
    return anomalies.select(
        iso_text(named(ts)).alias("date"),
        named(value).alias("value"),
        F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("row"),
    )


def analysis_context(df: DataFrame, anomalies: DataFrame, date_col: str, value_col: str) -> DataFrame:
    """One row: rows, cols, columns (name and type), date_col, value_col, anomalies_count and the
    first 20 anomalies in time order."""
    anomalies = found_points(anomalies)
    first = anomalies.orderBy(named(date_col), named(value_col)).limit(20)
    preview = first.agg(F.array_sort(F.collect_list(F.struct(named(date_col), named(value_col)))))
    types = F.array(*[F.concat_ws(" ", F.lit(f.name), F.lit(f.dataType.simpleString())) for f in df.schema])
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows",
        F.lit(len(df.columns)).alias("cols"),
        types.alias("columns"),
        F.lit(date_col).alias("date_col"),
        F.lit(value_col).alias("value_col"),
        anomalies.agg(F.count(F.lit(1))).scalar().alias("anomalies_count"),
        preview.scalar().alias("anomalies_preview"),
    )
