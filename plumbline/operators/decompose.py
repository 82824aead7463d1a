"""STL and MSTL anomaly detection, one resampled series per group, and the method chooser."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import all_named, named
from ..functions.loess import mstl, stl
from ..functions.text import number_of
from ..functions.times import FREQUENCIES, iso_text
from ..session import shuffle_partitions
from .anomaly import FENCE, LIMIT, classic, esd, iqr, moving_average, zscore
from .infer import infer_date_col, infer_value_col
from .series import MIN_POINTS, resample, time_of

# Seasons looked for by MSTL, in steps of the frequency.
SEASONS = {"D": [7, 365], "W": [52], "M": [12], "Q": [4]}


def _step_of(freq: str, ts: Column) -> Column:
    """Number of the period: consecutive periods have consecutive numbers."""
    return {
        "D": F.unix_date(ts.cast("date")),
        "W": F.floor((F.unix_date(ts.cast("date")) - 4) / 7),
        "M": F.year(ts) * 12 + F.month(ts) - 1,
        "Q": F.year(ts) * 4 + F.quarter(ts) - 1,
    }[freq].cast("bigint")


def _start_of(freq: str, step: Column) -> Column:
    n = step.cast("int")
    return {
        "D": F.date_from_unix_date(n),
        "W": F.date_from_unix_date(n * 7 + 4),
        "M": F.make_date(F.floor(n / 12).cast("int"), n % 12 + 1, F.lit(1)),
        "Q": F.make_date(F.floor(n / 4).cast("int"), n % 4 * 3 + 1, F.lit(1)),
    }[freq].cast("timestamp_ntz")


# A normal deviation in units of the median and of the mean absolute deviation.
NORMAL, NORMAL_OF_MEAN = 1.4826, 1.2533


def robust_score(residual: np.ndarray, level: float = 0.0) -> np.ndarray:
    """Deviations from the median in units of the scaled median absolute deviation, which outliers cannot stretch: up to half
    of the points may be any size without hiding one another. Where more than half of the residuals are equal (but for rounding, in values
    of about `level`), the mean absolute deviation stands in; where all are, nothing stands out."""
    away = residual - np.median(residual)
    size = np.abs(away)
    if not np.isfinite(size).all():
        return np.zeros(len(residual))
    noise = max(1e-12 * level, 1e-15 * size.max(initial=0.0))
    scale = NORMAL * np.median(size)
    if scale <= noise:
        scale = NORMAL_OF_MEAN * size.mean() if (size > noise).any() else np.inf
    return away / scale


def _residual_flags(residual: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray]:
    score = robust_score(residual, level)
    return np.abs(score) > LIMIT, score


def _decomposed(split: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]):
    def flags(steps: list[np.ndarray], values: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        found = [(np.zeros(len(step), bool), np.zeros(len(step))) for step in steps]
        whole = [i for i, value in enumerate(values) if np.isfinite(value).all()]  # nothing can be told by an infinite point
        if not whole:
            return found
        # periods without a point lie on a straight line
        filled = np.stack([np.interp(np.arange(steps[i][0], steps[i][-1] + 1), steps[i], values[i]) for i in whole], axis=1)
        season, trend = split(filled)
        residual = filled - season - trend
        for column, i in enumerate(whole):
            found[i] = _residual_flags(residual[steps[i] - steps[i][0], column], float(np.median(np.abs(values[i]))))
        return found

    return flags


def _fenced(steps: list[np.ndarray], values: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    found = []
    for value in values:
        q1, q3 = np.quantile(value, [0.25, 0.75])
        reach = FENCE * (q3 - q1)
        outside = np.maximum(q1 - reach - value, value - q3 - reach)
        found.append((outside > 0, np.where(q3 > q1, outside / (q3 - q1 or 1.0), outside)))
    return found


POINTS = 1 << 17  # points of whole series that a task works on at once


def _flagged(series: list[tuple[np.ndarray, np.ndarray]], methods: list) -> list[tuple]:
    """Of series that span equally many periods, (hits, scores, method, problem) each, by the first method that works."""
    problem = None
    for method, flags in methods:
        try:
            found = flags([step for step, _ in series], [value for _, value in series])
        except Exception as e:  # a failing method is reported, not raised
            if len(series) > 1:  # by the series that it fails on
                return [_flagged([one], methods)[0] for one in series]
            problem = f"{method}: {e}"
            continue
        return [(hit, score, method, None) for hit, score in found]
    return [(None, None, None, problem)] * len(series)


def _detected(table: pa.Table, names: Sequence[str], pick: Callable, out: list[str]) -> pa.Table:
    """Anomalies and failures of the whole series in `table`, which has their points in order, each series' first numbered 1."""
    steps, values = (table[c].to_numpy() for c in ("step", "value"))
    edges = np.append(np.flatnonzero(table["place"].to_numpy() == 1), len(steps))
    widths: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a >= MIN_POINTS:
            widths[int(steps[b - 1] - steps[a]) + 1].append((a, b))
    rows, scores, methods, errors = [], [], [], []
    for width, spans in widths.items():
        several = max(1, POINTS // width)
        for at in range(0, len(spans), several):
            part = spans[at : at + several]
            for (a, _), (hit, score, method, problem) in zip(part, _flagged([(steps[a:b], values[a:b]) for a, b in part], pick(width))):
                places = [a] if problem else (a + np.flatnonzero(hit)).tolist()
                rows += places
                scores += [None] if problem else score[hit].tolist()
                methods += [method] * len(places)
                errors += [problem] * len(places)
    told = table.take(pa.array(rows, pa.int64()))
    failed = pa.array([e is not None for e in errors], pa.bool_())
    blank = {c: pc.if_else(failed, pa.scalar(None, told.schema.field(c).type), told[c]) for c in ("step", "value")}
    columns = {**{c: told[c] for c in names}, **blank, "score": pa.array(scores, pa.float64()), "method": pa.array(methods, pa.string()), "error": pa.array(errors, pa.string())}
    return pa.table([columns[c] for c in out], names=out)


def _per_series(points: DataFrame, freq: str, by: Sequence[str], pick: Callable) -> DataFrame:
    names = [f"_g{i}" for i in range(len(by))]  # plain names for the Python step
    groups = [named(c).alias(g) for c, g in zip(by, names)]
    steps = points.select(*groups, _step_of(freq, F.col("ts")).alias("step"), F.col("value").cast("double").alias("value"))
    out = T.StructType([steps.schema[c] for c in names])
    out = out.add("step", "long").add("value", "double").add("score", "double")
    out = out.add("method", "string").add("error", "string")

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < POINTS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            firsts = np.flatnonzero(table["place"].to_numpy() == 1)
            if firsts[-1] > 0:  # the last series may go on
                yield from _detected(table.slice(0, firsts[-1]), names, pick, out.names).to_batches()
            held, size = table.slice(firsts[-1]).to_batches(), table.num_rows - firsts[-1]
        if held:
            yield from _detected(pa.Table.from_batches(held).combine_chunks(), names, pick, out.names).to_batches()

    if names:  # series are small in bytes but costly: keep them in many tasks
        steps = steps.repartition(shuffle_partitions(points.sparkSession), *names)
    line = W.partitionBy(*names).orderBy("step")
    placed = steps.withColumn("place", F.row_number().over(line)).sortWithinPartitions(*names, "step", "place")
    found = placed.mapInArrow(detect, out)
    back = [F.col(g).alias(c) for c, g in zip(by, names)]
    return found.select(*back, _start_of(freq, F.col("step")).alias("ts"), "value", "score", "method", "error")


def stl_anomalies(points: DataFrame, freq: str = "D", by: Sequence[str] = ()) -> DataFrame:
    """Resampled points whose STL residual is more than 3 robust deviations out. A series on which the
    method fails gives one row with `error` and no point."""
    period = FREQUENCIES[freq][2]
    return _per_series(points, freq, by, lambda n: [("stl", _decomposed(lambda y: stl(y, period)))])


def mstl_anomalies(points: DataFrame, freq: str = "D", by: Sequence[str] = ()) -> DataFrame:
    """As stl_anomalies, for several seasons at once."""
    periods = SEASONS[freq]
    return _per_series(points, freq, by, lambda n: [("mstl", _decomposed(lambda y: mstl(y, periods)))])


def auto_anomalies(points: DataFrame, freq: str = "D", by: Sequence[str] = ()) -> DataFrame:
    """STL where the series spans more than two seasons and the method works, else IQR fences."""
    period = FREQUENCIES[freq][2]
    by_stl, by_iqr = ("stl", _decomposed(lambda y: stl(y, period))), ("iqr", _fenced)
    return _per_series(points, freq, by, lambda n: [by_stl, by_iqr] if n > 2 * period else [by_iqr])


# Method names with the same meaning.
SAME_METHOD = {"simple": "zscore", "": "auto"}


def analyze(
    df: DataFrame,
    ts: str | None = None,
    value: str | None = None,
    method: str | None = None,
    freq: str = "D",
    by: Sequence[str] = (),
    how: str = "sum",
) -> DataFrame:
    """Anomalies by method name, in one shape: by..., date (ISO text), value, row (JSON), score, method, error.

    zscore (or simple), iqr and esd work on the rows, `row` has all their columns; classic,
    stl, mstl and moving_average on the series resampled to `freq`, `row` has its point; any other name
    is auto. Columns not named are inferred; without a date or a value column there are no
    anomalies. A series that is too short for its method gives one row with `error` and no point.
    """
    name = (method or "auto").lower()
    name = SAME_METHOD.get(name, name)
    ts, value = ts or infer_date_col(df), value or infer_value_col(df)
    if ts not in df.columns or value not in df.columns:
        groups = [df.schema[c] for c in by]
        shape = T.StructType(groups).add("date", "string").add("value", "double").add("row", "string").add("score", "double")
        return df.sparkSession.createDataFrame([], shape.add("method", "string").add("error", "string"))
    if name in ("zscore", "iqr", "esd"):
        return _of_rows(df, ts, value, name, by)
    points = resample(df, ts, value, freq, by, how)
    detect = {"moving_average": moving_average, "classic": lambda p, g: classic(p, freq, g)}.get(name)
    if detect:
        found = detect(points, by).withColumns({"method": F.lit(name), "error": F.lit(None).cast("string")})
    else:
        found = {"stl": stl_anomalies, "mstl": mstl_anomalies}.get(name, auto_anomalies)(points, freq, by)
    cells = F.to_json(F.struct(iso_text(F.col("ts")).alias(ts), F.col("value").alias(value)))
    found = found.select(*all_named(by), iso_text(F.col("ts")).alias("date"), "value", F.when(F.col("error").isNull(), cells).alias("row"), "score", "method", "error")
    return found.unionByName(_short(points, name, by, found.columns))


def _of_rows(df: DataFrame, ts: str, value: str, name: str, by: Sequence[str]) -> DataFrame:
    """zscore, iqr or esd over the rows that have a time and a value."""
    cells = [(iso_text(named(f.name)) if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) else named(f.name)).alias(f.name) for f in df.schema]
    groups = [named(c).alias(f"_by{i}") for i, c in enumerate(by)]
    keys = [f"_by{i}" for i in range(len(by))]
    rows = df.select(*groups, time_of(df, ts).alias("_ts"), number_of(df, value).alias("_value"), F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("_row"))
    rows = rows.where("_ts is not null and _value is not null")
    if name == "zscore":
        found = zscore(rows, "_value", keys)
    elif name == "iqr":
        found = iqr(rows, "_value", keys, least=MIN_POINTS).withColumn("score", F.greatest(F.col("low") - F.col("_value"), F.col("_value") - F.col("high")))
    else:
        keyed = rows.withColumn("_key", F.struct("_ts", "_row"))
        found = esd(keyed, "_value", "_key", keys).select(*keys, F.col("_key._ts").alias("_ts"), "_value", F.col("_key._row").alias("_row"), "score")
    back = [F.col(k).alias(c) for k, c in zip(keys, by)]
    none = F.lit(None).cast("string")
    found = found.select(*back, iso_text(F.col("_ts")).alias("date"), F.col("_value").alias("value"), F.col("_row").alias("row"), "score", F.lit(name).alias("method"), none.alias("error"))
    if name == "zscore":  # needs no least number of points
        return found
    return found.unionByName(_short(rows.select(*back, "_value"), name, by, found.columns))


def _short(points: DataFrame, name: str, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row for each series of fewer than MIN_POINTS points."""
    few = points.groupBy(*all_named(by)).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < MIN_POINTS)
    texts = {"method": F.lit(name), "error": F.format_string(f"{name}: %d points, at least {MIN_POINTS} are needed", "_n")}
    given = {"date": "string", "value": "double", "row": "string", "score": "double"}
    return few.select(*[named(c) if c in by else (texts[c] if c in texts else F.lit(None).cast(given[c])).alias(c) for c in columns])
