"""Coercion, inference and anomaly queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import to_number
from ..functions.times import coerce_timestamp, strict_timestamp
from ..operators.anomaly import (
    anomaly_rows,
    classic,
    esd,
    esd_steps,
    iqr,
    moving_average,
    narrative,
    summary,
    zscore,
)
from ..operators.decompose import analyze, auto_anomalies, mstl_anomalies, stl_anomalies
from ..operators.infer import coerce_timestamps, date_fractions, infer_value_col
from ..operators.quantile import exact_quantiles
from ..operators.profile import column_profile
from ..operators.series import long_enough, ordered, resample, series_points
from ..operators.sqlrun import QueryError, run_sql
from .derived import WITH_DAILY, daily
from .quality import ZSCORE_SQL
from .registry import plan, table

TIMES_SPARK = {
    "o_orderkey": "o_orderkey",
    "iso": "case when o_orderkey % 7 = 0 then 'not a date' when o_orderkey % 11 = 0 then '' else date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') end",
    "us": "case when o_orderkey % 4 = 0 then '99/99/1999' else date_format(o_orderdate, 'MM/dd/yyyy') end",
    "amount": "case when o_orderkey % 5 = 0 then '1d' when o_orderkey % 9 = 0 then ' 12.5 ' when o_orderkey % 13 = 0 then '1e3' else cast(o_custkey as string) end",
}
TIMES_SQL = (
    "with texts as (select o_orderkey, o_orderdate, case when o_orderkey % 7 = 0 or o_orderkey % 11 = 0 then null else o_orderdate end as iso, "
    "case when o_orderkey % 4 <> 0 then o_orderdate end as us, "
    "case when o_orderkey % 5 = 0 then null when o_orderkey % 9 = 0 then 12.5 when o_orderkey % 13 = 0 then 1000.0 else o_custkey end as amount from orders) "
)


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(*[f"{e} as {n}" for n, e in TIMES_SPARK.items()])


@plan("coerce_timestamp", TIMES_SQL + "select o_orderkey, iso, us from texts")
def coerce_timestamp_plan(spark, sf_dir):
    rows = _texts(spark, sf_dir)
    return rows.select("o_orderkey", coerce_timestamp(rows["iso"]).alias("iso"), coerce_timestamp(rows["us"]).alias("us"))


@plan("coerce_number", TIMES_SQL + "select o_orderkey, cast(amount as double) as amount from texts")
def coerce_number_plan(spark, sf_dir):
    rows = _texts(spark, sf_dir)
    return rows.select("o_orderkey", to_number(rows["amount"]).alias("amount"))


@plan(
    "infer_date_col",
    TIMES_SQL
    + "select 'iso' as name, round(count(iso) / count(*), 6) as fraction, false as parses from texts "
    "union all select 'us', round(count(us) / count(*), 6), false from texts union all select 'amount', 0.0, false",
)
def infer_date_plan(spark, sf_dir):
    """The fractions on which the choice of a date column rests."""
    return date_fractions(_texts(spark, sf_dir)).select("name", F.round("fraction", 6).alias("fraction"), "parses")


@plan("series_prepare", TIMES_SQL + "select iso as ts, cast(amount as double) as value from texts where iso is not null and amount is not null order by ts")
def series_prepare(spark, sf_dir):
    return ordered(series_points(_texts(spark, sf_dir), "iso", "amount"))


@plan("resample_series", "select o_orderpriority, date_trunc('week', o_orderdate) as ts, round(sum(o_totalprice), 2) as value from orders group by 1, 2")
def resample_series(spark, sf_dir):
    weekly = resample(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "W", ["o_orderpriority"])
    return weekly.withColumn("value", F.round("value", 2))


@plan("resample_quarterly", "select date_trunc('quarter', l_shipdate) as ts, cast(count(l_quantity) as double) as value from lineitem group by 1")
def resample_quarterly(spark, sf_dir):
    return resample(table(spark, sf_dir, "lineitem"), "l_shipdate", "l_quantity", "Q", how="count")


_SCORED = "event_id, ts, value, round(score, 6) as score"


@plan("anomaly_zscore", f"select {_SCORED} from ({ZSCORE_SQL})")
def anomaly_zscore(spark, sf_dir):
    return zscore(table(spark, sf_dir, "events"), "value").select("event_id", "ts", "value", F.round("score", 6).alias("score"))


@plan(
    "anomaly_zscore_by_dim",
    "select event_id, event_type, value, round((value - m) / s, 6) as score from events join "
    "(select event_type, avg(value) as m, stddev_samp(value) as s from events group by 1) using (event_type) where abs((value - m) / s) > 3",
)
def anomaly_zscore_by_dim(spark, sf_dir):
    found = zscore(table(spark, sf_dir, "events"), "value", ["event_type"])
    return found.select("event_id", "event_type", "value", F.round("score", 6).alias("score"))


@plan(
    "anomaly_zscore_by_customer",
    "select o_orderkey, round((o_totalprice - m) / s, 6) as score from orders join "
    "(select o_custkey, avg(o_totalprice) as m, stddev_samp(o_totalprice) as s from orders group by 1 having count(*) > 1) using (o_custkey) "
    "where s > 0 and abs((o_totalprice - m) / s) > 2",
)
def anomaly_zscore_by_customer(spark, sf_dir):
    """Many small groups."""
    found = zscore(table(spark, sf_dir, "orders"), "o_totalprice", ["o_custkey"], limit=2.0)
    return found.select("o_orderkey", F.round("score", 6).alias("score"))


@plan("anomaly_summary", f"select count(*) as count, 'zscore' as method_used from ({ZSCORE_SQL})")
def anomaly_summary(spark, sf_dir):
    return summary(zscore(table(spark, sf_dir, "events"), "value"), "zscore")


@plan(
    "anomaly_narrative",
    "select 'Analysis used method=zscore. Found ' || count(*) || ' anomalies. Inspect flagged points for root cause.' as narrative "
    f"from ({ZSCORE_SQL})",
)
def anomaly_narrative(spark, sf_dir):
    return narrative(summary(zscore(table(spark, sf_dir, "events"), "value"), "zscore"))


@plan(
    "anomaly_rows",
    "select strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when ts = date_trunc('second', ts) then '' else strftime(ts, '.%f') end as date, "
    f"value, event_id, event_type from ({ZSCORE_SQL})",
)
def anomaly_rows_plan(spark, sf_dir):
    rows = anomaly_rows(zscore(table(spark, sf_dir, "events"), "value"), "ts", "value")
    return rows.select(
        "date", "value", F.get_json_object("row", "$.event_id").cast("bigint").alias("event_id"),
        F.get_json_object("row", "$.event_type").alias("event_type"),
    )


@plan("anomaly_min_points", "select o_custkey, count(*) as points from orders group by 1 having count(*) >= 8")
def anomaly_min_points(spark, sf_dir):
    points = series_points(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", ["o_custkey"])
    return long_enough(points, ["o_custkey"])


_FENCES = "quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3"


@plan(
    "anomaly_iqr",
    f"select event_id, value from events, (select {_FENCES} from events) where value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)",
)
def anomaly_iqr(spark, sf_dir):
    return iqr(table(spark, sf_dir, "events"), "value").select("event_id", "value")


@plan(
    "anomaly_iqr_by_dim",
    f"select event_id, value, round(q1 - 1.5 * (q3 - q1), 6) as low, round(q3 + 1.5 * (q3 - q1), 6) as high from events join (select event_type, {_FENCES} from events group by 1) using (event_type) "
    "where value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)",
)
def anomaly_iqr_by_dim(spark, sf_dir):
    found = iqr(table(spark, sf_dir, "events"), "value", ["event_type"])
    return found.select("event_id", "value", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@plan(
    "quantiles_by_rank",
    "select l_returnflag, count(*) as n, round(quantile_cont(l_extendedprice, 0.25), 6) as q1, round(quantile_cont(l_extendedprice, 0.5), 6) as q2, "
    "round(quantile_cont(l_extendedprice, 0.9), 6) as q9 from lineitem group by 1",
)
def quantiles_by_rank(spark, sf_dir):
    probs = {"q1": 0.25, "q2": 0.5, "q9": 0.9}
    found = exact_quantiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", probs, ["l_returnflag"])
    return found.select("l_returnflag", "n", *[F.round(c, 6).alias(c) for c in probs])


_FLAG = (
    "select ts, round(value, 2) as value, round((e - em) / es, 6) as score from "
    "(select *, avg(e) over () as em, stddev_samp(e) over () as es from resid) where abs((e - em) / es) > 3"
)


@plan(
    "anomaly_moving_average",
    WITH_DAILY.rstrip()
    + ", resid as (select ts, value, value - avg(value) over (order by ts rows between 6 preceding and current row) as e from daily) "
    + _FLAG,
)
def anomaly_moving_average(spark, sf_dir):
    return moving_average(daily(spark, sf_dir)).select("ts", F.round("value", 2).alias("value"), F.round("score", 6).alias("score"))


@plan(
    "anomaly_classic",
    WITH_DAILY.rstrip()
    + ", d as (select *, dayofweek(ts) as ph, case when count(*) over w = 7 then value - avg(value) over w end as dt from daily "
    "window w as (order by ts rows between 3 preceding and 3 following)), "
    "phase as (select ph, avg(dt) as pm from d group by 1), "
    "resid as (select ts, value, dt - (pm - (select avg(pm) from phase)) as e from d join phase using (ph)) "
    + _FLAG,
)
def anomaly_classic(spark, sf_dir):
    return classic(daily(spark, sf_dir), "D").select("ts", F.round("value", 2).alias("value"), F.round("score", 6).alias("score"))


@plan(
    "anomaly_classic_monthly",
    "with monthly as (select o_orderpriority as g, date_trunc('month', o_orderdate) as ts, avg(o_totalprice) as value from orders group by 1, 2), "
    "d as (select *, month(ts) as ph, case when count(*) over a = 12 and count(*) over b = 12 then value - (avg(value) over a + avg(value) over b) / 2 end as dt from monthly "
    "window a as (partition by g order by ts rows between 6 preceding and 5 following), b as (partition by g order by ts rows between 5 preceding and 6 following)), "
    "phase as (select g, ph, avg(dt) as pm from d group by 1, 2), level as (select g, avg(pm) as lv from phase group by 1), "
    "resid as (select g, ts, value, dt - (pm - lv) as e from d join phase using (g, ph) join level using (g)), "
    "z as (select g, ts, (e - avg(e) over (partition by g)) / stddev_samp(e) over (partition by g) as score from resid) "
    "select g as o_orderpriority, ts, round(score, 6) as score from z where abs(score) > 2",
)
def anomaly_classic_monthly(spark, sf_dir):
    """A season of even length, one series per group."""
    by = ["o_orderpriority"]
    points = resample(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "M", by, "avg")
    return classic(points, "M", by, limit=2.0).select(*by, "ts", F.round("score", 6).alias("score"))


@plan("anomaly_esd")
def anomaly_esd(spark, sf_dir):
    return esd(table(spark, sf_dir, "events"), "value", "event_id", ["event_type"])


@plan("anomaly_stl")
def anomaly_stl(spark, sf_dir):
    return stl_anomalies(daily(spark, sf_dir), "D")


def _by_priority(spark, sf_dir, freq):
    return resample(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", freq, ["o_orderpriority"])


@plan("anomaly_mstl")
def anomaly_mstl(spark, sf_dir):
    return mstl_anomalies(_by_priority(spark, sf_dir, "D"), "D", ["o_orderpriority"])


@plan("anomaly_auto")
def anomaly_auto(spark, sf_dir):
    return auto_anomalies(_by_priority(spark, sf_dir, "W"), "W", ["o_orderpriority"])


@plan(
    "esd_statistics",
    "with recursive v as (select event_type as g, list(value order by value) as xs, count(*) as n, avg(value) as m, var_samp(value) as s2 from events group by 1), "
    "step as (select g, xs, n, m, 0 as i, 1 as lo, n as hi, 0.0::double as total, s2 * (n - 1) as sq, 0 as side, 0.0::double as value, 0.0::double as statistic from v "
    "union all select g, xs, n, m, i + 1, case when low then lo + 1 else lo end, case when low then hi else hi - 1 end, "
    "total - (x - m), sq - (x - m) * (x - m), case when low then -1 else 1 end, x, abs(x - m - mean) / sqrt(spread) from "
    "(select *, case when low then xs[lo] else xs[hi] end as x from (select *, mean - (xs[lo] - m) > (xs[hi] - m) - mean as low from "
    "(select *, total / (n - i) as mean, (sq - total * total / (n - i)) / (n - i - 1) as spread from step where i < n // 10)))) "
    "select g as event_type, i::bigint as i, side::int as side, value, round(statistic, 6) as statistic from step where i > 0",
)
def esd_statistics(spark, sf_dir):
    """Every removal of the test and its statistic; which are significant is in anomaly_esd."""
    steps = esd_steps(table(spark, sf_dir, "events"), "value", ["event_type"])
    return steps.select("event_type", "i", "side", "value", F.round("statistic", 6).alias("statistic"))


def _with_infinity(spark, sf_dir):
    """events with one infinite click."""
    return run_sql(
        table(spark, sf_dir, "events"),
        "select event_id, event_type, ts, case when event_id = (select min(event_id) from loaded_table where event_type = 'click') then double('infinity') else value end as value from loaded_table",
    )


@plan("anomaly_zscore_infinite", "select event_id, value from events where false")
def anomaly_zscore_infinite(spark, sf_dir):
    """A deviation that is no number flags nothing."""
    return zscore(_with_infinity(spark, sf_dir), "value").select("event_id", "value")


@plan(
    "anomaly_zscore_by_dim_infinite",
    "select event_id, event_type, value, round((value - m) / s, 6) as score from events join "
    "(select event_type, avg(value) as m, stddev_samp(value) as s from events where event_type <> 'click' group by 1) using (event_type) where abs((value - m) / s) > 3",
)
def anomaly_zscore_by_dim_infinite(spark, sf_dir):
    found = zscore(_with_infinity(spark, sf_dir), "value", ["event_type"])
    return found.select("event_id", "event_type", "value", F.round("score", 6).alias("score"))


@plan(
    "profile_infinite",
    "select 'value' as name, min(value) as min, 'infinity'::double as max, 'infinity'::double as mean, null::double as std from events",
)
def profile_infinite(spark, sf_dir):
    return column_profile(_with_infinity(spark, sf_dir)).where("name = 'value'").select("name", "min", "max", "mean", "std")


def _spiked(spark, sf_dir):
    """Daily sums per priority; one day a year, another each year, is a million times as high."""
    points = resample(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "D", ["o_orderpriority"])
    spike = F.dayofyear("ts") == F.year("ts") * 37 % 300 + 10
    return points.withColumn("value", F.when(spike, F.col("value") * 1_000_000).otherwise(F.col("value")))


_SPIKES_SQL = (
    "select distinct o_orderpriority, date_trunc('day', o_orderdate) as ts from orders where dayofyear(o_orderdate) = year(o_orderdate) * 37 % 300 + 10"
)


@plan("anomaly_stl_spikes", _SPIKES_SQL)
def anomaly_stl_spikes(spark, sf_dir):
    """Spikes planted by date are all found, and of the high points no other."""
    return stl_anomalies(_spiked(spark, sf_dir), "D", ["o_orderpriority"]).where("value > 1e9").select("o_orderpriority", "ts")


@plan("anomaly_mstl_spikes", _SPIKES_SQL)
def anomaly_mstl_spikes(spark, sf_dir):
    return mstl_anomalies(_spiked(spark, sf_dir), "D", ["o_orderpriority"]).where("value > 1e9").select("o_orderpriority", "ts")


@plan("anomaly_auto_spikes", _SPIKES_SQL)
def anomaly_auto_spikes(spark, sf_dir):
    return auto_anomalies(_spiked(spark, sf_dir), "D", ["o_orderpriority"]).where("value > 1e9").select("o_orderpriority", "ts")


@plan("anomaly_spikes_counted")
def anomaly_spikes_counted(spark, sf_dir):
    """What each method flags of the spiked series: planted spikes, and other points."""
    points = _spiked(spark, sf_dir)
    found = None
    for method, find in (("stl", stl_anomalies), ("mstl", mstl_anomalies), ("auto", auto_anomalies)):
        rows = find(points, "D", ["o_orderpriority"]).where("error is null").select("o_orderpriority", "ts", F.lit(method).alias("asked"))
        found = rows if found is None else found.unionByName(rows)
    planted = F.dayofyear("ts") == F.year("ts") * 37 % 300 + 10
    counts = found.groupBy("asked", "o_orderpriority").agg(F.count_if(planted).alias("planted"), F.count_if(~planted).alias("others"))
    return counts.withColumnRenamed("asked", "method")


_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when ts = date_trunc('second', ts) then '' else strftime(ts, '.%f') end"


@plan("analyze_zscore", f"select {_ISO} as date, value, event_id, round(score, 6) as score, 'zscore' as method, null::varchar as error from ({ZSCORE_SQL})")
def analyze_zscore(spark, sf_dir):
    found = analyze(table(spark, sf_dir, "events"), "ts", "value", "simple")
    return found.select("date", "value", F.get_json_object("row", "$.event_id").cast("bigint").alias("event_id"), F.round("score", 6).alias("score"), "method", "error")


@plan(
    "analyze_iqr",
    f"select event_type, {_ISO} as date, value, event_id from events join (select event_type, {_FENCES} from events group by 1) using (event_type) "
    "where value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)",
)
def analyze_iqr(spark, sf_dir):
    found = analyze(table(spark, sf_dir, "events"), "ts", "value", "iqr", by=["event_type"])
    return found.select("event_type", "date", "value", F.get_json_object("row", "$.event_id").cast("bigint").alias("event_id"))


@plan(
    "analyze_errors",
    "select o_custkey, 'stl: ' || n || ' points, at least 8 are needed' as error from "
    "(select o_custkey, count(distinct date_trunc('month', o_orderdate)) as n from orders group by 1) where n < 8",
)
def analyze_errors(spark, sf_dir):
    """Series too short for their method say so."""
    found = analyze(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "stl", "M", ["o_custkey"])
    return found.where("error like '%points, at least%'").select("o_custkey", "error")


def _too_short(spark, sf_dir):
    """Every day of the table, in series of at most eleven days: ten days of a month each."""
    third = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2)).cast("int")
    return daily(spark, sf_dir).withColumn("month", F.date_format("ts", "yyyy-MM")).withColumn("third", third)


@plan("anomaly_summary_errors", "select count(*) + 1 as count, 'stl' as method_used from (select distinct strftime(o_orderdate, '%Y') from orders)")
def anomaly_summary_errors(spark, sf_dir):
    """Rows that report a failure are no anomalies: ten days are too few for two weeks. Beside them stand series that have one
    anomaly each: days of the year in an exact weekly rhythm, but for one; and one more of all years."""
    short = _too_short(spark, sf_dir).select(F.concat_ws("-", "month", "third").alias("series"), "ts", "value")
    days = F.explode(F.sequence(F.lit("2020-01-01").cast("date"), F.lit("2020-06-30").cast("date"))).alias("day")
    years = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy").alias("series")).distinct()
    years = years.unionByName(years.agg(F.concat(F.min("series"), F.lit("-"), F.max("series")).alias("series")))
    value = 100.0 + 10 * F.dayofweek("day") + F.when(F.col("day") == F.lit("2020-04-01").cast("date"), 5000.0).otherwise(0.0)
    regular = years.select("series", days).select("series", F.col("day").cast("timestamp_ntz").alias("ts"), value.alias("value"))
    return summary(stl_anomalies(short.unionByName(regular), "D", ["series"]), "stl")


@plan("strict_timestamps", "select o_orderkey, date_trunc('day', o_orderdate) as ts from orders")
def strict_timestamps(spark, sf_dir):
    """Dates as text, every one of which must parse."""
    return table(spark, sf_dir, "orders").select("o_orderkey", strict_timestamp(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("ts"))


@plan(
    "infer_value_column",
    "select 'customer' as source, 'c_acctbal' as \"column\", max(c_acctbal) as largest from customer union all "
    "select 'orders', 'o_totalprice', max(o_totalprice) from orders union all select 'part', 'p_retailprice', max(p_retailprice) from part",
)
def infer_value_column(spark, sf_dir):
    """The column that stands for the value where none is named: the last numeric one."""
    found = None
    for name in ("customer", "orders", "part"):
        df = table(spark, sf_dir, name)
        column = infer_value_col(df)
        row = df.agg(F.max(column).cast("double").alias("largest")).select(F.lit(name).alias("source"), F.lit(column).alias("column"), "largest")
        found = row if found is None else found.unionByName(row)
    return found


@plan(
    "sql_rejected",
    "select 'SELECT COUNT(*) AS n FROM loaded_table' as query, count(*) as n, false as rejected from orders union all "
    "select unnest(['INVALID SQL GARBAGE', 'DROP TABLE loaded_table', 'SELECT no_such FROM loaded_table', '']), null, true",
)
def sql_rejected(spark, sf_dir):
    """Texts that are no valid query are refused before anything runs."""
    orders, found = table(spark, sf_dir, "orders"), []
    for text in ("SELECT COUNT(*) AS n FROM loaded_table", "INVALID SQL GARBAGE", "DROP TABLE loaded_table", "SELECT no_such FROM loaded_table", ""):
        try:
            found.append((text, run_sql(orders, text).first()["n"], False))
        except QueryError:
            found.append((text, None, True))
    return spark.createDataFrame(found, "query string, n long, rejected boolean")


_LAYOUTS = ("M/d/yyyy h:mm a", "yyyy-MM-dd h:mm a", "MMM d yyyy", "d MMMM yyyy", "dd-MMM-yy", "yyyyMMdd HH:mm", "MMMM yyyy", "yyyy.MM.dd", "MMMM d, yyyy HH:mm:ss")


@plan(
    "coerce_timestamp_layouts",
    "select o_orderkey, case o_orderkey % 9 when 0 then date_trunc('minute', o_orderdate) when 1 then date_trunc('minute', o_orderdate) when 5 then date_trunc('minute', o_orderdate) "
    "when 6 then date_trunc('month', o_orderdate) when 8 then date_trunc('second', o_orderdate) else date_trunc('day', o_orderdate) end as ts from orders",
)
def coerce_timestamp_layouts(spark, sf_dir):
    """Dates as people write them, one layout by another."""
    text = F.lit(None).cast("string")
    for i, layout in enumerate(_LAYOUTS):
        text = F.when(F.col("o_orderkey") % len(_LAYOUTS) == i, F.date_format("o_orderdate", layout)).otherwise(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", coerce_timestamp(text).alias("ts"))


@plan(
    "coerce_timestamp_dayfirst",
    "select o_orderkey, date_trunc('day', o_orderdate) as european, date_trunc('day', o_orderdate) as american, "
    "case when o_orderkey % 50 > 0 then date_trunc('day', o_orderdate) when day(o_orderdate) <= 12 then make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate))::timestamp end as mixed, "
    "date_trunc('minute', o_orderdate) as dashed from orders",
)
def coerce_timestamp_dayfirst(spark, sf_dir):
    """Each column of dates says itself whether the day or the month comes first."""
    day_first, month_first = F.date_format("o_orderdate", "d/M/yyyy"), F.date_format("o_orderdate", "MM/dd/yyyy")
    texts = table(spark, sf_dir, "orders").select(
        "o_orderkey", day_first.alias("european"), month_first.alias("american"), F.when(F.col("o_orderkey") % 50 == 0, month_first).otherwise(day_first).alias("mixed"),
        F.concat(F.lit(" "), F.date_format("o_orderdate", "dd-MM-yyyy H:mm")).alias("dashed"),
    )
    return coerce_timestamps(texts, ["european", "american", "mixed", "dashed"])
