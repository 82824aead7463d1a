import contextlib
import io

import pytest
from oracle import connect, differences

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
PLANS, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def _text(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(PLANS))
def test_query(spark, duck, name):
    df = PLANS[name](spark, SF)
    assert not any(bad in _text(df) for bad in ("CartesianProduct", "BatchEvalPython", "BroadcastNestedLoopJoin"))
    if name in ORACLES:
        assert differences(df, duck, ORACLES[name]) is None
    else:
        df.collect()


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_scans_are_pruned_and_filtered(spark):
    text = _text(PLANS["anomaly_zscore"](spark, SF))
    assert "ReadSchema: struct<value:double>" in text and "props" not in text
    text = _text(PLANS["sql_filter"](spark, SF))
    assert "GreaterThanOrEqual(o_totalprice,1000.0)" in text and "In(o_orderstatus" in text


def test_samples_are_ranked_before_the_shuffle(spark):
    assert "WindowGroupLimit" in _text(PLANS["violation_samples"](spark, SF))


def test_profile_and_checks_scan_once(spark):
    for name in ("profile_report", "rule_max"):
        assert _text(PLANS[name](spark, SF)).count("Scan parquet") == 2  # once in the tree, once in its details


def test_top_k_needs_no_sort(spark):
    for name in ("profile_sample", "sample_random", "sql_topk"):
        assert "TakeOrderedAndProject" in _text(PLANS[name](spark, SF))


def test_every_order_comes_back_from_dated_workbooks(spark):
    sf = "/root/testdata/sf0.01"  # more keys than a workbook holds: both date systems
    assert differences(PLANS["scan_xlsx_dates_whole"](spark, sf), connect(sf), "select o_orderkey, date_trunc('second', o_orderdate) as o_orderdate, o_totalprice from orders") is None


def test_every_day_is_in_a_series_that_reports_it_is_too_short(spark):
    from collections import Counter

    from plumbline.operators import stl_anomalies
    from plumbline.plans.derived import daily
    from plumbline.plans.series import _too_short

    sf = "/root/testdata/sf0.01"
    days = [r["ts"] for r in daily(spark, sf).collect()]
    sizes = Counter((f"{d:%Y-%m}", min((d.day - 1) // 10, 2)) for d in days)
    want = sorted(s for s, n in sizes.items() if n >= 8)
    found = stl_anomalies(_too_short(spark, sf), "D", ["month", "third"]).collect()
    assert len(want) > 100 and sorted((r["month"], r["third"]) for r in found) == want
    assert all("too few" in r["error"] for r in found)


@pytest.mark.parametrize("name", ["anomaly_stl_spikes", "anomaly_mstl_spikes", "anomaly_auto_spikes"])
def test_spikes_are_found_in_longer_tables(spark, name):
    sf = "/root/testdata/sf0.01"
    assert differences(PLANS[name](spark, sf), connect(sf), ORACLES[name]) is None


def test_spikes_add_no_false_alarms(spark):
    """The same series without its spikes has about as many flagged points."""
    from plumbline.operators import resample, stl_anomalies
    from plumbline.plans.registry import table

    sf = "/root/testdata/sf0.01"
    counted = [r for r in PLANS["anomaly_spikes_counted"](spark, sf).collect() if r["method"] == "stl"]
    plain = stl_anomalies(resample(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "D", ["o_orderpriority"]), "D", ["o_orderpriority"]).count()
    assert sum(r["planted"] for r in counted) == 26 and abs(sum(r["others"] for r in counted) - plain) < 0.05 * plain
