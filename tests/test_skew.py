"""One key holds a third of the rows, or more; results must equal brute force."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import asof_join, count_within, distinct_on, exact_distinct, exact_quantiles, range_join, repeated_values, sample_by_key
from plumbline.operators.skew import frequent_hashes, hot_keys, range_index, split_join, with_chunks

T0 = pd.Timestamp("2024-01-01")


def _events(rng, n, users, spread):
    user = np.where(rng.random(n) < 0.4, 0, rng.integers(1, users, n))
    at = rng.integers(0, spread, n)
    return pd.DataFrame({"u": user, "sec": at, "id": np.arange(n)})


def _frame(spark, pdf, prefix):
    df = spark.createDataFrame(pdf)
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("sec")).cast("timestamp_ntz")
    return df.select("u", ts.alias(f"{prefix}_ts"), F.col("id").alias(f"{prefix}_id")).repartition(7)


@pytest.mark.parametrize("users,spread", [(40, 100_000), (3, 300), (400, 5)])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_asof_join(spark, users, spread, how):
    rng = np.random.default_rng(users)
    left, right = _events(rng, 1500, users, spread), _events(rng, 900, users, spread)
    got = asof_join(_frame(spark, left, "l"), _frame(spark, right, "r"), "l_ts", ["u"], "r_ts", how)
    got = {r["l_id"]: r["r_id"] for r in got.collect()}
    last = right.sort_values(["sec", "id"]).drop_duplicates(["u", "sec"], keep="last")
    want = pd.merge_asof(left.sort_values("sec"), last.sort_values("sec").rename(columns={"id": "r_id"}), on="sec", by="u")
    want = {int(a): (None if pd.isna(b) else int(b)) for a, b in zip(want["id"], want["r_id"])}
    if how == "inner":
        want = {k: v for k, v in want.items() if v is not None}
    assert got == want


def test_asof_join_with_a_third_of_copies_and_missing_keys(spark):
    rows = [(0, 50, i) for i in range(500)] + [(i % 20, i, 500 + i) for i in range(900)] + [(None, 5, 2000), (1, None, 2001)]
    left = spark.createDataFrame(rows, "u long, sec long, id long").selectExpr("u", "timestamp_seconds(sec) :: timestamp_ntz as ts", "id")
    right = spark.createDataFrame([(0, 50, 1), (0, 49, 9), (3, 10, 2), (None, 1, 3)] * 50, "u long, sec long, v long")
    right = right.selectExpr("u", "timestamp_seconds(sec) :: timestamp_ntz as ts", "v")
    got = asof_join(left, right, "ts", ["u"], how="left").collect()
    assert len(got) == len(rows)
    by_id = {r["id"]: r["v"] for r in got}
    for u, sec, i in rows:
        want = None
        if u == 0 and sec is not None and sec >= 49:
            want = 1 if sec >= 50 else 9
        if u == 3 and sec >= 10:
            want = 2
        assert by_id[i] == want


@pytest.mark.parametrize("users,spread", [(30, 50_000), (2, 50)])
def test_count_within(spark, users, spread):
    rng = np.random.default_rng(users)
    points, buys = _events(rng, 1200, users, spread), _events(rng, 600, users, spread)
    width = spread // 5
    intervals = spark.createDataFrame(buys).selectExpr("u", f"sec - {width} as lo", "sec as hi", "id")
    got = count_within(spark.createDataFrame(points).select("u", "sec"), intervals, "sec", "lo", "hi", "id", ["u"])
    got = {r["id"]: r["n"] for r in got.collect()}
    for u, sec, i in buys.itertuples(index=False):
        mine = points[(points.u == u) & (points.sec >= sec - width) & (points.sec <= sec)]
        assert got[i] == len(mine)


@pytest.mark.parametrize("share", [0.0, 0.4])
def test_range_join(spark, share):
    rng = np.random.default_rng(1)
    points = [(i, float(v)) for i, v in enumerate(np.where(rng.random(400) < share, 50.0, rng.uniform(0, 100, 400)))]
    spans = [(j, float(a), float(a + rng.uniform(0, 9))) for j, a in enumerate(rng.uniform(-5, 100, 60))] + [(99, 5.0, 1.0)]
    got = range_join(
        spark.createDataFrame(points, "i int, v double"), spark.createDataFrame(spans, "j int, a double, b double"),
        F.col("v"), F.col("a"), F.col("b"), 5.0,
    ).collect()
    assert sorted((r["i"], r["j"]) for r in got) == sorted((i, j) for i, v in points for j, a, b in spans if a <= v <= b)


@pytest.mark.parametrize("width", [1.0, 16.0])
def test_range_join_of_every_length(spark, width):
    """From one place to the whole range, and without an end: no interval is copied more than twice a level."""
    rng = np.random.default_rng(2)
    points = [(i, float(v)) for i, v in enumerate(rng.integers(-3000, 3000, 500))] + [(900, float("nan")), (901, None)]
    spans = [(j, float(a), float(a + 2.0 ** (j % 14))) for j, a in enumerate(rng.integers(-3000, 3000, 120))]
    spans += [(500, float("-inf"), 0.0), (501, 10.0, float("inf")), (502, float("-inf"), float("inf")), (503, 7.0, 7.0), (504, 8.0, 2.0), (505, None, 3.0)]
    left, right = spark.createDataFrame(points, "i int, v double"), spark.createDataFrame(spans, "j int, a double, b double")
    got = range_join(left, right, F.col("v"), F.col("a"), F.col("b"), width).where("not isnan(v)").collect()
    want = sorted((i, j) for i, v in points[:500] for j, a, b in spans if a is not None and a <= v <= b)
    assert sorted((r["i"], r["j"]) for r in got) == want


@pytest.mark.parametrize("width, groups", [(1.0, 1), (16.0, 3), (5000.0, 2)])
def test_range_join_of_sums_makes_no_pairs(spark, width, groups):
    rng = np.random.default_rng(3)
    points = [(int(v) % groups, float(v), 1, int(v)) for v in np.where(rng.random(3000) < 0.4, 50, rng.integers(-3000, 3000, 3000))] + [(0, None, 1, 7), (None, 3.0, 1, 3)]
    spans = [(int(a) % groups, j, float(a), float(a + 2.0 ** (j % 14))) for j, a in enumerate(rng.integers(-3000, 3000, 120))]
    spans += [(0, 500, float("-inf"), 0.0), (0, 501, 10.0, float("inf")), (0, 502, float("-inf"), float("inf")), (0, 503, 7.0, 7.0), (0, 504, 8.0, 2.0), (0, 505, None, 3.0), (None, 506, 0.0, 9.0)]
    spans += [(0, 600 + j, 40.0, float("inf")) for j in range(300)] + [(0, 506, 5000.0, 9000.0), (0, 507, 49.5, 50.5)]
    left, right = spark.createDataFrame(points, "g int, v double, one long, x long"), spark.createDataFrame(spans, "g int, j int, a double, b double")
    met = range_join(left, right, F.col("v"), F.col("a"), F.col("b"), width, ["g"], ["one", "x"])
    assert sorted(met.columns) == ["a", "b", "g", "j", "one", "x"]
    rows = met.collect()
    got = {}
    for r in rows:
        n, x = got.get((r["g"], r["j"]), (0, 0))
        got[r["g"], r["j"]] = (n + r["one"], x + r["x"])
    want = {}
    for g, j, a, b in spans:
        held = [x for h, v, _, x in points if None not in (g, h, v, a) and g == h and a <= v <= b]
        if held:
            want[g, j] = (len(held), sum(held))
    assert got == want
    if width < 100:  # two nodes a level, and the places in two bins
        assert len(rows) <= len(spans) * (2 * 13 + 2 * width)


def test_exact_distinct_and_repeated_values(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([None, 0, -1, -40_000, 2**40, rng.randint(-70_000, 70_000)]), None, rng.choice(["", None, "long " * 50 + str(rng.randint(0, 30)), f"own {i}"])) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, a long, b int, t string").repartition(5)
    got = {r["column"]: r["distinct"] for r in exact_distinct(df, ["a", "b", "id"]).collect()}
    assert got == {"a": len({r[1] for r in rows} - {None}), "b": 0, "id": 2000}
    counts = Counter(r[3] for r in rows)
    assert {(r["id"], r["n"]) for r in repeated_values(df, "t", "id").collect()} == {(r[0], counts[r[3]]) for r in rows if r[3] is not None and counts[r[3]] > 1}


def test_samples_do_not_depend_on_partitioning(spark):
    df = spark.range(3000).selectExpr("id", "id % 3 as g", "case when id % 10 = 0 then 100.0 when id % 10 = 1 then 0.0 else 1.0 end as w")
    taken = [sorted(r["id"] for r in sample_by_key(df.repartition(parts), "id", 40, ["g"], "w").collect()) for parts in (1, 9)]
    assert taken[0] == taken[1] and len(taken[0]) == 120
    assert sum(i % 10 == 0 for i in taken[0]) > 90 and not any(i % 10 == 1 for i in taken[0])
    small, large = ({r["id"] for r in sample_by_key(df, "id", n, seed="x").collect()} for n in (30, 60))
    assert small < large


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles(spark, by):
    rng = np.random.default_rng(9)
    values = np.round(rng.exponential(50, 6000), 2)
    values[::3] = 7.5  # a third are copies
    groups = np.where(rng.random(6000) < 0.5, 0, rng.integers(1, 200, 6000))
    df = spark.createDataFrame([(None if g == 5 else int(g), float(v)) for g, v in zip(groups, values)] + [(1, None)], "g int, v double")
    probs = {"lo": 0.0, "q": 0.25, "m": 0.5, "h": 0.999, "hi": 1.0}
    got = exact_quantiles(df.repartition(6), "v", probs, by).collect()
    for row in got:
        key = row["g"] if by else None
        mine = values if not by else values[groups == (5 if key is None else key)]
        assert row["n"] == len(mine)
        assert np.allclose([row[c] for c in probs], np.quantile(mine, list(probs.values())))
    assert len(got) == (len(set(groups)) if by else 1)


def test_split_join(spark):
    rows = [("hot" if i % 3 == 0 else None if i % 5 == 0 else f"k{i % 97}", i) for i in range(3000)]
    left = spark.createDataFrame(rows, "k string, i int").repartition(5)
    sums = left.groupBy("k").agg(F.count("*").alias("n"), F.sum("i").alias("s"))
    got = split_join(left, sums, ["k"], "n").collect()
    want = pd.DataFrame(rows, columns=["k", "i"]).groupby("k", dropna=False)["i"].agg(["size", "sum"])
    assert len(got) == 3000
    lookup = {(None if pd.isna(k) else k): tuple(v) for k, v in zip(want.index, want.itertuples(index=False))}
    assert all((r["n"], r["s"]) == lookup[r["k"]] for r in got)
    empty = left.where("false")
    assert split_join(empty, empty.groupBy("k").agg(F.count("*").alias("n")), ["k"], "n").count() == 0


def test_chunks_bound_the_largest_group(spark):
    df = spark.range(20_000).selectExpr("if(id % 2 = 0, 0, id) as k", "id * id % 10007 as v")
    assert [tuple(r) for r in hot_keys(df, ["k"]).collect()] == [(0,)]
    out, used = with_chunks(df, ["k"], "v", df)
    assert used
    chunks = out.where("k = 0").groupBy("_chunk").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).orderBy("_chunk").collect()
    assert max(r["n"] for r in chunks) < 10_000 / 4
    assert all(x["b"] < y["a"] for x, y in zip(chunks, chunks[1:]))
    plain, used = with_chunks(spark.range(1000).selectExpr("id as k", "id as v"), ["k"], "v", spark.range(1000).selectExpr("id as k", "id as v"))
    assert not used and plain.where("_chunk <> 0").count() == 0


def test_range_index(spark):
    cuts = [1, 5, 5, 9, 12, 20, 21]
    values = list(range(-2, 25))
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = [r[0] for r in df.select(range_index(F.col("v"), F.lit(cuts), 3)).collect()]
    assert got == [sum(c <= v for c in cuts) for v in values]


def test_distinct_on(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 3, "z"), (1, 3, "a"), (2, 9, None)], "k int, t int, s string")
    assert sorted(tuple(r) for r in distinct_on(df, ["k"], "t").collect()) == [(1, 3, "a"), (2, 9, None)]


def test_no_key_is_shuffled_to_find_hot_ones(spark):
    """Every key above 1/p of the rows is among the candidates, also with many others, null keys and several columns."""
    rng = np.random.default_rng(4)
    keys = np.where(rng.random(20_000) < 0.15, 7, np.where(rng.random(20_000) < 0.2, -1, rng.integers(100, 9000, 20_000)))
    df = spark.createDataFrame([(None if k == -1 else int(k), f"t{k % 2}") for k in keys], "a int, b string").repartition(6)
    for names in (["a"], ["b"], ["a", "b"]):
        counts = Counter(tuple(r) for r in df.select(*names).collect())
        want = {k for k, n in counts.items() if n * 8 > len(keys)}
        hashes, total = frequent_hashes(df, names)
        assert total == len(keys) and len(hashes) < 16
        assert {tuple(r) for r in hot_keys(df, names).collect()} == want
    assert hot_keys(spark.range(10_000), ["id"]) is None and hot_keys(spark.range(0), ["id"]) is None
