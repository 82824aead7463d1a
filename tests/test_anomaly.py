import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.loess import loess, mstl, stl
from plumbline.functions.student import esd_limits, t_upper
from plumbline.operators.anomaly import _sure_limit, esd_steps
from plumbline.operators import (
    analysis_context,
    analyze,
    anomaly_rows,
    auto_anomalies,
    classic,
    esd,
    iqr,
    long_enough,
    moving_average,
    narrative,
    resample,
    stl_anomalies,
    summary,
    zscore,
)

TS10 = [10, 12, 11, 100, 13, 11, 12, 10, 11, 9]
TS15 = [10, 12, 11, 10, 13, 11, 12, 10, 11, 9, 12, 10, 11, 10, 1000]


def _daily(spark, values, start="2024-01-01", **extra):
    rows = [(i, float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, value double")
    return df.select(F.date_add(F.lit(start).cast("date"), F.col("i")).cast("timestamp_ntz").alias("ts"), "value")


def test_zscore_fixtures(spark):
    assert zscore(_daily(spark, TS10), "value").count() == 0  # 10 points cannot reach 3
    found = zscore(_daily(spark, TS15), "value").collect()
    assert [(r["value"], round(r["score"], 4)) for r in found] == [(1000.0, 3.6148)]
    assert zscore(_daily(spark, [5] * 20), "value").count() == 0
    text = spark.createDataFrame([(str(v),) for v in TS15] + [("n/a",), (None,)], "value string")
    assert [r["value"] for r in zscore(text, "value").collect()] == ["1000"]


def test_zscore_by_group(spark):
    rows = [("a", float(v)) for v in TS15] + [("b", float(v)) for v in TS15[:-1]] + [(None, float(-v)) for v in TS15]
    found = zscore(spark.createDataFrame(rows, "g string, value double"), "value", ["g"]).collect()
    assert {(r["g"], r["value"]) for r in found} == {("a", 1000.0), (None, -1000.0)}


def test_report_forms(spark):
    df = _daily(spark, TS15).withColumn("ts", F.col("ts") + F.expr("interval 7 seconds 179500 microseconds"))
    found = zscore(df, "value")
    row = anomaly_rows(found, "ts", "value").first()
    assert row["date"] == "2024-01-15T00:00:07.179500" and row["value"] == 1000.0
    assert '"ts":"2024-01-15T00:00:07.179500"' in row["row"]
    assert summary(found, "zscore").first().asDict() == {"count": 1, "method_used": "zscore"}
    text = narrative(summary(found, "zscore")).first()["narrative"]
    assert text == "Analysis used method=zscore. Found 1 anomalies. Inspect flagged points for root cause."
    context = analysis_context(df, found, "ts", "value").first()
    assert (context["rows"], context["cols"], context["anomalies_count"]) == (15, 2, 1)
    assert [p["value"] for p in context["anomalies_preview"]] == [1000.0]


def test_iqr_against_numpy(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(0, 1, 500), [9, -8]])
    q1, q3 = np.quantile(values, [0.25, 0.75])
    want = sorted(v for v in values if v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1))
    df = spark.createDataFrame([(float(v),) for v in values] + [(float("nan"),), (None,)], "value double")
    assert sorted(r["value"] for r in iqr(df, "value").collect()) == want


def test_t_quantiles_of_the_printed_tables():
    got = t_upper(np.array([0.025, 0.05, 0.005, 0.0005]), np.array([10.0, 5, 30, 6]))
    assert np.allclose(got, [2.2281, 2.0150, 2.7500, 5.9588], atol=5e-5)
    assert np.allclose(esd_limits(54, 3, 0.05), [3.158, 3.151, 3.143], atol=1e-3)  # Rosner 1983


def _esd_brute(values, alpha=0.05):
    x, k = np.array(values), len(values) // 10
    taken, outliers = [], 0
    for i, bound in enumerate(esd_limits(len(values), k, alpha)):
        dev = np.abs(x - x.mean())
        at = dev.argmax()
        taken.append(x[at])
        if dev[at] / x.std(ddof=1) > bound:
            outliers = i + 1
        x = np.delete(x, at)
    return sorted(taken[:outliers])


@pytest.mark.parametrize("by", [[], ["g"]])
def test_esd_against_brute_force(spark, by):
    rng = np.random.default_rng(5)
    rows, want = [], []
    sizes = [8, 30, 60, 150, 1500] if by else [1500]
    for g, n in enumerate(sizes):
        v = rng.standard_t(2, n) * 10
        v[: n // 15] = 77.7  # equal values among the extremes
        rows += [(g, len(rows) + i, float(x)) for i, x in enumerate(v)]
        if n >= 10:
            want += [(g, x) for x in _esd_brute(v)]
    df = spark.createDataFrame(rows, "g int, id int, value double").repartition(5)
    found = esd(df, "value", "id", by).withColumn("g", F.col("g") if by else F.lit(0)).collect()
    assert sorted((r["g"], r["value"]) for r in found) == sorted(want)
    assert len({r["id"] for r in found}) == len(found)
    assert max(sum(r["g"] == g for r in found) for g in range(len(sizes))) > 50  # no limit but n // 10


def _brute_loess(y, q, x):
    d = np.abs(np.arange(len(y)) - x)
    near = np.argsort(d, kind="stable")[: min(q, len(y))]
    h = d[near].max() + max(0, (q - len(y)) // 2)
    w = (1 - (d[near] / (h * 1.001)) ** 3) ** 3
    a, b = np.polyfit(near, y[near], 1, w=np.sqrt(w))
    return a * x + b


@pytest.mark.parametrize("q", [5, 9, 61])
def test_loess_against_polyfit(q):
    y = np.random.default_rng(0).normal(size=40).cumsum()
    at = np.array([-1, 0, 3, 20, 36, 39, 40])
    assert np.allclose(loess(y, q, at, np.ones(40)), [_brute_loess(y, q, x) for x in at])
    both = loess(np.stack([y, 2 * y], 1), q, at, np.ones((40, 2)))
    assert np.allclose(both[:, 1], 2 * both[:, 0])


def test_stl_and_mstl_recover_their_parts():
    t = np.arange(900)
    week, year = 5 * np.sin(2 * np.pi * t / 7), 20 * np.sin(2 * np.pi * t / 365)
    season, trend = stl(week + 0.1 * t + np.random.default_rng(0).normal(0, 0.01, 900), 7)
    assert np.abs(season - week).max() < 0.1 and np.abs(trend - 0.1 * t).max() < 0.1
    season, trend = mstl(week + year + 0.01 * t, [7, 365])
    assert np.abs(week + year + 0.01 * t - season - trend).max() < 1.0
    with pytest.raises(ValueError):
        stl(t[:14].astype(float), 7)


@pytest.mark.parametrize("method", ["classic", "stl", "mstl", "moving_average", "auto", "esd", "iqr", "zscore", "simple", None, "unknown"])
def test_every_method_finds_a_spike(spark, method):
    t = np.arange(120)
    values = 100 + 10 * np.sin(2 * np.pi * t / 7) + np.random.default_rng(2).normal(0, 0.5, 120)
    values[60] += 500
    df = _daily(spark, values).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    found = analyze(df, "day", "value", method).collect()
    assert any(abs(r["value"] - values[60]) < 1e-9 for r in found)
    assert len(found) < 40 and all(r["error"] is None for r in found)
    assert analyze(df, "day", "value", method).columns == ["date", "value", "row", "score", "method", "error"]


def test_columns_are_inferred(spark):
    df = _daily(spark, TS15).withColumn("other", F.lit("x"))
    assert [r["value"] for r in analyze(df, method="iqr").collect()] == [1000.0]
    assert analyze(df.drop("value")).count() == 0 and analyze(df.select("value")).count() == 0
    few = analyze(df.where("ts > '2024-01-09'"), method="iqr").collect()  # fewer than 8 points
    assert [(r["value"], r["error"]) for r in few] == [(None, "iqr: 6 points, at least 8 are needed")]
    assert analyze(df.where("ts > '2024-01-09'"), method="simple").count() == 0


def test_names_with_dots(spark):
    rows = [(g, i, float(v)) for g in ("a", "b") for i, v in enumerate(TS15)]
    df = spark.createDataFrame(rows, "`g.x` string, id int, `v.y` double")
    assert zscore(df, "v.y", ["g.x"]).count() == 2 and iqr(df, "v.y", ["g.x"]).count() == 2
    assert esd(df, "v.y", "id", ["g.x"]).count() == 2
    df = df.where("id > 2").withColumn("t.t", F.date_add(F.lit("2024-01-01").cast("date"), F.col("id")))
    points = resample(df, "t.t", "v.y", "D", ["g.x"])
    found = auto_anomalies(points, "D", ["g.x"]).collect()  # 12 points: too few for STL
    assert sorted((r["g.x"], r["value"], r["method"]) for r in found) == [("a", 1000.0, "iqr"), ("b", 1000.0, "iqr")]


def test_gaps_and_groups_and_partitions(spark):
    t = np.arange(60)
    base = 50 + 5 * np.sin(2 * np.pi * t / 7) + np.random.default_rng(4).normal(0, 0.2, 60)
    rows = []
    for g in ("a", "b"):
        v = base.copy()
        v[30 if g == "a" else 40] += 300
        rows += [(g, int(i), float(x)) for i, x in zip(t, v) if i not in (10, 11, 25)]
    df = spark.createDataFrame(rows, "g string, i int, value double")
    df = df.withColumn("ts", F.date_add(F.lit("2023-06-01").cast("date"), F.col("i")))
    for find in (stl_anomalies, auto_anomalies, classic):
        results = set()
        for parts in (1, 7):
            points = resample(df.repartition(parts), "ts", "value", "D", ["g"])
            hits = find(points, "D", ["g"]).where("abs(value) > 200").select("g", "ts").collect()
            results.add(tuple(sorted((r["g"], str(r["ts"])[:10]) for r in hits)))
        assert results == {(("a", "2023-07-01"), ("b", "2023-07-11"))}
    points = resample(df, "ts", "value", "D", ["g"])
    hits = moving_average(points, ["g"]).where("value > 200").collect()
    assert {r["g"] for r in hits} == {"a", "b"}


@pytest.mark.parametrize("freq,n,start", [("W", 150, "2018-01-01"), ("M", 60, "2018-01-01"), ("Q", 40, "2010-01-01")])
def test_coarser_frequencies(spark, freq, n, start):
    unit = {"W": "week", "M": "month", "Q": "quarter"}[freq]
    step = {"W": "7 days", "M": "1 month", "Q": "3 months"}[freq]
    times = spark.sql(f"select explode(sequence(date '{start}', date '{start}' + interval '{n - 1}' month * 4, interval {step})) as d")
    df = times.orderBy("d").limit(n).withColumn("value", 10.0 + F.quarter("d") + F.when(F.col("d") == F.date_trunc(unit, F.lit("2019-07-01").cast("date")).cast("date"), 90.0).otherwise(0.0))
    assert df.where("value > 90").count() == 1
    for find in (stl_anomalies, auto_anomalies):
        hits = find(resample(df, "d", "value", freq), freq).where("value > 90").collect()
        assert len(hits) == 1 and hits[0]["error"] is None
        assert df.where(F.col("d").cast("timestamp_ntz") == F.lit(hits[0]["ts"])).count() == 1


def test_infinite_values_flag_nothing(spark):
    values = [float(v) for v in np.random.default_rng(1).normal(100, 5, 60)]
    values[7] = float("inf")
    df = _daily(spark, values)
    assert zscore(df, "value").count() == 0 and iqr(df, "value").count() <= 3
    groups = df.withColumn("g", F.lit("a")).unionByName(_daily(spark, TS15).withColumn("g", F.lit("b")))
    assert [r["g"] for r in zscore(groups, "value", ["g"]).collect()] == ["b"]
    assert moving_average(df).count() == 0 and classic(df).count() == 0 and esd(df.withColumn("id", F.col("ts")), "value", "id").count() == 0
    for find in (stl_anomalies, auto_anomalies):
        assert find(df).where("error is null").count() == 0
    text = spark.createDataFrame([(str(i),) for i in range(49)] + [("inf",)], "value string")
    assert zscore(text, "value").count() == 0
    both = spark.createDataFrame([(float("inf"),), (float("-inf"),), (1.0,)] * 4, "value double")
    assert iqr(both, "value").count() == 0


def test_errors_are_no_anomalies(spark):
    found = stl_anomalies(_daily(spark, TS15[:10]))
    assert found.count() == 1 and summary(found, "stl").first()["count"] == 0


def test_short_series_are_left_alone_and_errors_reported(spark):
    short = _daily(spark, TS15[:7])
    assert stl_anomalies(short).count() == 0 and long_enough(short).count() == 0
    twelve = stl_anomalies(_daily(spark, TS15[:12])).collect()  # too few for two weeks
    assert len(twelve) == 1 and twelve[0]["ts"] is None and "too few" in twelve[0]["error"]
    auto = auto_anomalies(_daily(spark, TS15[:11] + [1000])).collect()
    assert [(r["value"], r["method"]) for r in auto] == [(1000.0, "iqr")]


def _plain_line(y, w, at, q):
    """A weighted straight line through the q points nearest to `at`, there."""
    n = len(y)
    q_ = min(q, n)
    first = int(min(max(at - (q_ - 1) // 2, 0), n - q_))
    reach = max(at - first, first + q_ - 1 - at) + max(0, (q - n) // 2)
    x = np.arange(first, first + q_) - at
    u = (1 - np.clip(np.abs(x) / (max(reach, 1e-9) * 1.001), 0, 1) ** 3) ** 3 * w[first : first + q_]
    u = u / u.sum()
    v, mx, my = y[first : first + q_], 0.0, 0.0
    mx, my = (u * x).sum(), (u * v).sum()
    spread = (u * x * x).sum() - mx * mx
    return my - mx * (((u * x * v).sum() - mx * my) / spread if spread > 1e-12 else 0.0)


def _plain_weights(size):
    scale = 6 * np.median(size)
    return np.array([max(max(0.0, 1 - (r / scale) ** 2) ** 2, 1e-12 / (1 + r / scale) ** 2) for r in size])


def _plain_stl(y, period, seasonal=7, outer=5):
    n, odd = len(y), lambda x: int(np.ceil(x)) // 2 * 2 + 1
    span = odd(1.5 * period / (1 - 1.5 / seasonal))

    def smooth(v, q, w):
        at = sorted({*range(0, n, max(1, -(-q // 10))), n - 1})
        return np.interp(np.arange(n), at, [_plain_line(v, w, x, q) for x in at])

    padded = np.concatenate([y[7:0:-1], y, y[-2:-9:-1]])
    w = _plain_weights(np.array([abs(y[i] - np.median(padded[i : i + 15])) for i in range(n)]))
    season, trend = np.zeros(n), np.zeros(n)
    for k in range(outer + 1):
        for _ in range(2):
            cycle = np.zeros(n + 2 * period)
            for phase in range(period):
                own = np.arange(phase, n, period)
                for j in range(-1, len(own) + 1):
                    cycle[phase + period * (j + 1)] = _plain_line((y - trend)[own], w[own], j, seasonal)
            low = cycle
            for width in (period, period, 3):
                low = np.array([low[i : i + width].mean() for i in range(len(low) - width + 1)])
            season = cycle[period : n + period] - smooth(low, odd(period), np.ones(n))
            trend = smooth(y - season, span, w)
        if k < outer:
            w = _plain_weights(np.abs(y - season - trend))
    return season, trend


def test_flags_of_a_spiked_series_equal_a_plain_version(spark):
    """Spikes of unlike size do not hide each other, and the false alarms are those of a plain reading of the definitions."""
    t = np.arange(330)
    rng = np.random.default_rng(8)
    values = 100 + 9 * np.sin(2 * np.pi * t / 7) + rng.standard_t(3, 330)
    spikes = {50: 5e8, 130: 5e7, 137: 300.0, 260: 1e12}
    for at, v in spikes.items():
        values[at] = v
    season, trend = _plain_stl(values, 7)
    rest = values - season - trend
    score = (rest - np.median(rest)) / (1.4826 * np.median(np.abs(rest - np.median(rest))))
    want = sorted(int(i) for i in np.flatnonzero(np.abs(score) > 3))
    assert set(spikes) <= set(want) and 0 < len(want) - len(spikes) < 60
    found = stl_anomalies(_daily(spark, values)).select(F.datediff("ts", F.lit("2024-01-01")).alias("i"), "score").collect()
    first = min(r["ts"] for r in _daily(spark, values).collect())
    shift = (first.date() if hasattr(first, "date") else first).toordinal() - __import__("datetime").date(2024, 1, 1).toordinal()
    assert sorted(r["i"] - shift for r in found) == want
    assert all(abs(r["score"] - score[r["i"] - shift]) <= 1e-6 * abs(score[r["i"] - shift]) + 1e-6 for r in found)


def test_robust_score():
    from plumbline.operators.decompose import robust_score

    assert (robust_score(np.full(20, 3.0)) == 0).all()
    lone = np.zeros(60)
    lone[7] = 90.0  # more than half of the residuals are equal
    assert abs(robust_score(lone)[7]) > 3 and abs(robust_score(lone)[8]) < 3
    assert (robust_score(np.array([1.0, np.inf, 2.0])) == 0).all()
    hidden = np.append(np.random.default_rng(0).normal(size=100), [1e9] * 30 + [50.0])
    assert (np.abs(robust_score(hidden)[100:]) > 3).all()


def test_no_critical_value_is_below_the_sure_limit(spark):
    for alpha in (0.05, 0.2, 0.001):
        sizes = [10, 11, 19, 25, 40, 99, 250, 1000, 5000]
        sure = {r["n"]: r["x"] for r in spark.createDataFrame([(n,) for n in sizes], "n long").select("n", _sure_limit(F.col("n"), alpha).alias("x")).collect()}
        for n in sizes:
            least = min(esd_limits(n, n // 10, alpha))
            assert sure[n] <= least and (n < 250 or sure[n] > 0.9 * least)


@pytest.mark.parametrize("shape", ["normal", "heavy", "uniform", "masked", "ties", "skewed"])
def test_pruned_steps_hold_every_outlier(spark, shape):
    """Pruned or not, the removals up to the last significant one are the same."""
    rng = np.random.default_rng(5)
    values = {
        "normal": rng.normal(size=4000),
        "heavy": rng.standard_t(2, size=4000),
        "uniform": rng.uniform(size=4000),
        "masked": np.concatenate([rng.normal(size=3900), rng.normal(60, 1, 60), [1e6] * 3, rng.normal(-30, 1, 37)]),
        "ties": np.round(rng.normal(size=4000)) * 1.0,
        "skewed": rng.exponential(size=4000) ** 2,
    }[shape]
    df = spark.createDataFrame([(float(v),) for v in values], "value double")

    def outliers(pruned):
        steps = sorted(tuple(r) for r in esd_steps(df, "value", pruned=pruned).collect())
        last = max((s[0] for s in steps if s[4] > s[5]), default=0)
        return [s[:4] for s in steps if s[0] <= last], len(steps)

    (want, every), (got, some) = outliers(False), outliers(True)
    assert got == want and every == 400 and some <= every
    assert shape not in ("normal", "uniform") or some < 40


def test_a_long_skewed_series_leaves_its_task_few_values(spark):
    df = spark.range(3_000_000).selectExpr("cast(id % 9 = 0 as int) as g", "randn(3) + case when id % 100000 = 0 then 50 else 0 end as value")
    steps = esd_steps(df, "value", ["g"], pruned=True).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("statistic") > F.col("critical")).alias("out")).collect()
    assert sum(r["out"] for r in steps) >= 30 and all(r["n"] < 2000 for r in steps)


def test_series_decomposed_together_are_as_alone():
    rng = np.random.default_rng(5)
    for n, period in ((80, 12), (27, 12), (61, 7)):
        y = rng.normal(0, 1, (n, 30)) + 5 * np.sin(np.arange(n) * 2 * np.pi / period)[:, None]
        y[:, 3], y[:, 4], y[5, 6] = 7.0, np.arange(n), 1e9
        for together, alone in ((stl(y, period), [stl(y[:, j], period) for j in range(30)]), (mstl(y, [period]), [mstl(y[:, j], [period]) for j in range(30)])):
            for j in range(30):
                assert np.array_equal(together[0][:, j], alone[j][0]) and np.array_equal(together[1][:, j], alone[j][1])


def test_many_series_share_a_task_and_come_out_apart(spark, monkeypatch):
    """Cut anywhere between batches, of unlike lengths, with infinite points and failures of their own."""
    from plumbline.operators import decompose

    rng = np.random.default_rng(6)
    rows = []
    for k in range(60):
        n = int(rng.integers(5, 70))
        values = rng.normal(0, 1, n)
        values[n // 2] += 50
        if k % 10 == 0:
            values[0] = np.inf
        rows += [(None if k == 7 else k, int(i), float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k int, i int, value double").select("k", F.add_months(F.lit("2015-01-01"), F.col("i")).cast("timestamp_ntz").alias("ts"), "value")
    together = stl_anomalies(df, "M", ["k"])
    out = sorted(map(repr, together.collect()))
    monkeypatch.setattr(decompose, "POINTS", 50)
    assert sorted(map(repr, stl_anomalies(df, "M", ["k"]).collect())) == out
    sizes, flagged = {}, {}
    for k, i, v in rows:
        sizes.setdefault(k, []).append(v)
    for k, values in sizes.items():
        y, n = np.array(values), len(values)
        if n < 8 or not np.isfinite(y).all():
            continue
        if n <= 24:
            flagged[k] = f"stl: {n} points are too few for a season of 12"
        else:
            season, trend = stl(y, 12)
            flagged[k] = {round(float(v), 6) for v, s in zip(y, decompose.robust_score(y - season - trend)) if abs(s) > 3}
    got = {}
    for r in together.collect():
        if r["error"]:
            got[r["k"]] = r["error"]
        else:
            got.setdefault(r["k"], set()).add(round(r["value"], 6))
    assert got == {k: v for k, v in flagged.items() if v}
