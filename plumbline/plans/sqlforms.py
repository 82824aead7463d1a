"""SQL over `loaded_table`: one query per family of the SQL surface.

Most windows and per-key lists run over rows that were grouped first, to months, types or flags;
those over single rows go by order, which has few lines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import micros
from ..operators.asof import asof_join
from ..operators.distinct import exact_distinct
from ..operators.profile import sample_by_key
from ..operators.rangecount import count_within
from ..operators.rangejoin import range_join
from ..operators.sqlrun import distinct_on, preview_sql, run_sql
from .registry import plan, sql_plan, table

sql_plan("sql_select_limit", "select * from loaded_table order by o_orderkey limit 2", "orders")
sql_plan("sql_count", "SELECT COUNT(*) AS cnt FROM loaded_table", "lineitem")


@plan("sql_preview", "select o_orderkey, o_orderstatus, o_totalprice from orders order by o_orderkey limit 100")
def sql_preview(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").orderBy("o_orderkey")
    return run_sql(orders, preview_sql("loaded_table", ["o_orderkey", "o_orderstatus", "o_totalprice"]))


sql_plan(
    "sql_project",
    "select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as net, "
    "concat(l_returnflag, '-', l_linestatus) as flags, l_quantity * 2 as double_qty from loaded_table",
    "lineitem",
)
sql_plan(
    "sql_filter",
    "select o_orderkey, o_totalprice, o_orderpriority from loaded_table where o_totalprice between 1000 and 90000 "
    "and o_orderstatus in ('F', 'O') and (o_orderpriority like '1-%' or o_orderpriority ilike '%low%') and o_custkey is not null",
    "orders",
)
sql_plan(
    "sql_join_inner",
    # orders are folded per customer before the join, so a customer with many orders is one row in it
    "select n_name, cast(sum(n) as bigint) as n_orders, cast(sum(total) as double) as revenue from "
    "(select o_custkey, count(*) as n, sum(cast(o_totalprice as decimal(18,2))) as total from loaded_table group by o_custkey) t "
    "join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name",
    "orders",
    ("customer", "nation"),
)
sql_plan(
    "sql_join_left",
    "select c_custkey, c_name, coalesce(n, 0) as n_orders, last_date from customer left join "
    "(select o_custkey, count(*) as n, max(o_orderdate) as last_date from loaded_table group by o_custkey) t on c_custkey = o_custkey",
    "orders",
    ("customer",),
)
sql_plan(
    "sql_join_right",
    "select p_partkey, t.n from (select l_partkey, count(*) as n from loaded_table where l_quantity > 45 group by l_partkey) t "
    "right join part on l_partkey = p_partkey",
    "lineitem",
    ("part",),
)
sql_plan(
    "sql_join_outer",
    "select coalesce(a.o_custkey, b.o_custkey) as custkey, a.n as n_f, b.n as n_p from "
    "(select o_custkey, count(*) as n from loaded_table where o_orderstatus = 'F' group by 1) a full outer join "
    "(select o_custkey, count(*) as n from loaded_table where o_orderstatus = 'P' group by 1) b on a.o_custkey = b.o_custkey",
    "orders",
)

_TIERS = "(select cast(floor(c_acctbal / 500) as int) as tier, min(c_acctbal) as lo, max(c_acctbal) as hi from customer group by 1)"


@plan("sql_join_theta", f"select s_suppkey, s_acctbal, tier from supplier join {_TIERS} on s_acctbal between lo and hi")
def sql_join_theta(spark, sf_dir):
    """Suppliers in the balance tiers observed among customers: an inequality join by bins."""
    tiers = table(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_acctbal") / 500).cast("int").alias("tier"))
    tiers = tiers.agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    joined = range_join(suppliers, tiers, F.col("s_acctbal"), F.col("lo"), F.col("hi"), 500)
    return joined.select("s_suppkey", "s_acctbal", "tier")


@plan(
    "sql_join_interval",
    "select p.event_id as purchase_id, count(c.event_id) as clicks from (select * from events where event_type = 'purchase') p "
    "left join (select * from events where event_type = 'click') c on p.user_id = c.user_id and c.ts between p.ts - interval 6 hours and p.ts group by 1",
)
def sql_join_interval(spark, sf_dir):
    """Clicks of the same user in the 6 hours before each purchase, counted without pairs."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", micros(F.col("ts")).alias("at"))
    clicks = events.where("event_type = 'click'").select("user_id", "at")
    start = F.col("at") - 6 * 3600 * 1_000_000
    buys = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), start.alias("since"), F.col("at").alias("until"))
    return count_within(clicks, buys, "at", "since", "until", "purchase_id", ["user_id"]).withColumnRenamed("n", "clicks")


@plan(
    "asof_join",
    "select p.event_id as purchase_id, p.user_id, p.ts, c.event_id as click_id, c.ts as click_ts from "
    "(select * from events where event_type = 'purchase') p asof join (select * from events where event_type = 'click') c "
    "on p.user_id = c.user_id and p.ts >= c.ts",
)
def asof_join_plan(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    buys = events.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", "ts")
    clicks = events.where("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"))
    return asof_join(buys, clicks, "ts", ["user_id"], right_on="click_ts").select("purchase_id", "user_id", "ts", "click_id", "click_ts")


sql_plan(
    "sql_semi",
    "select o_orderkey, o_totalprice from loaded_table o where exists (select 1 from "
    "(select l_orderkey from lineitem where l_returnflag = 'R' and l_quantity > 40 group by l_orderkey) r where r.l_orderkey = o.o_orderkey)",
    "orders",
    ("lineitem",),
)
sql_plan(
    "sql_anti",
    "select c_custkey, c_name from customer c where not exists (select 1 from "
    "(select o_custkey from loaded_table where o_orderstatus = 'F' group by o_custkey) f where f.o_custkey = c.c_custkey)",
    "orders",
    ("customer",),
)
sql_plan(
    "sql_group",
    "select l_returnflag, l_linestatus, count(*) as n, cast(sum(cast(l_quantity as decimal(18,2))) as double) as qty, "
    "round(avg(l_extendedprice), 4) as avg_price, min(l_shipdate) as first_ship, max(l_shipdate) as last_ship, "
    "round(stddev_samp(l_extendedprice), 4) as std_price from loaded_table group by l_returnflag, l_linestatus",
    "lineitem",
)
sql_plan(
    "sql_distinct_agg",
    "select l_returnflag, count(distinct l_suppkey) as suppliers, count(*) filter (where l_discount > 0.05) as discounted "
    "from loaded_table group by l_returnflag having count(*) > 10",
    "lineitem",
)
_GROUPED = "select l_returnflag, l_linestatus, count(*) as n, cast(grouping(l_returnflag) as int) as g1, cast(grouping(l_linestatus) as int) as g2 from loaded_table group by "
sql_plan("sql_rollup", _GROUPED + "rollup (l_returnflag, l_linestatus)", "lineitem")
sql_plan("sql_cube", _GROUPED + "cube (l_returnflag, l_linestatus)", "lineitem")
sql_plan("sql_grouping_sets", _GROUPED + "grouping sets ((l_returnflag), (l_linestatus), ())", "lineitem")
sql_plan(
    "sql_quantiles",
    # l_quantity takes few distinct values, so the exact percentile buffers stay small
    "select l_returnflag, median(l_quantity) as med, percentile_cont(0.25) within group (order by l_quantity) as q25, "
    "percentile_cont(0.9) within group (order by l_quantity) as q90 from loaded_table group by l_returnflag",
    "lineitem",
)

_MONTHS = (
    "with m as (select o_orderpriority as p, cast(year(o_orderdate) * 12 + month(o_orderdate) as bigint) as mi, count(*) as n, "
    "cast(sum(cast(o_totalprice as decimal(18,2))) as double) as v from loaded_table group by 1, 2) "
)
sql_plan(
    "sql_rank",
    _MONTHS + "select p, mi, cast(row_number() over (partition by p order by n desc, mi) as bigint) as rn, "
    "cast(rank() over (partition by p order by n desc) as bigint) as rk, cast(dense_rank() over (partition by p order by n desc) as bigint) as dr, "
    "cast(ntile(4) over (partition by p order by n desc, mi) as bigint) as quartile, "
    "round(percent_rank() over (partition by p order by n desc), 6) as pr, round(cume_dist() over (partition by p order by n desc), 6) as cd from m",
    "orders",
)
sql_plan(
    "sql_lag_lead",
    _MONTHS + "select p, mi, lag(n) over w as before, lead(n, 2, 0) over w as after2, first_value(n) over w as first_n, "
    "last_value(n) over (partition by p order by mi rows between unbounded preceding and unbounded following) as last_n, "
    "nth_value(n, 2) over w as second_n from m window w as (partition by p order by mi)",
    "orders",
    oracle=_MONTHS + "select p, mi, lag(n) over w as before, lead(n, 2, 0::bigint) over w as after2, first_value(n) over w as first_n, "
    "last_value(n) over (partition by p order by mi rows between unbounded preceding and unbounded following) as last_n, "
    "nth_value(n, 2) over w as second_n from m window w as (partition by p order by mi)",
)
sql_plan(
    "sql_frames",
    _MONTHS + "select p, mi, round(avg(v) over (partition by p order by mi rows between 2 preceding and current row), 2) as avg3, "
    "cast(sum(n) over (partition by p order by mi range between 3 preceding and 1 following) as bigint) as near, "
    "cast(sum(n) over (partition by p order by mi) as bigint) as running from m",
    "orders",
)
sql_plan(
    "sql_qualify",
    _MONTHS + "select p, mi, n from (select *, row_number() over (partition by p order by n desc, mi) as rn from m) where rn <= 3",
    "orders",
    oracle=_MONTHS + "select p, mi, n from m qualify row_number() over (partition by p order by n desc, mi) <= 3",
)
sql_plan("sql_topk", "select o_orderkey, o_totalprice from loaded_table order by o_totalprice desc, o_orderkey limit 10 offset 5", "orders")
sql_plan("sql_distinct", "select distinct o_orderstatus, o_orderpriority from loaded_table", "orders")


@plan("sql_distinct_on", "select distinct on (o_custkey) * from orders order by o_custkey, o_orderdate, o_orderkey")
def sql_distinct_on(spark, sf_dir):
    return distinct_on(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate")


sql_plan(
    "sql_union",
    "select o_custkey as k from loaded_table where o_orderstatus = 'F' union select o_custkey from loaded_table where o_orderstatus = 'P' "
    "union all select c_custkey from customer where c_acctbal < 0",
    "orders",
    ("customer",),
)
sql_plan("sql_intersect", "select o_custkey as k from loaded_table where o_orderstatus = 'F' intersect select o_custkey from loaded_table where o_orderstatus = 'P'", "orders")
sql_plan("sql_except", "select c_custkey as k from customer except select o_custkey from loaded_table where o_totalprice > 200000", "orders", ("customer",))


@plan("sql_union_by_name", "select s_suppkey as k, s_acctbal as bal, null as seg from supplier union all by name select c_mktsegment as seg, c_custkey as k, c_acctbal as bal from customer")
def sql_union_by_name(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("seg"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"))
    return suppliers.unionByName(customers, allowMissingColumns=True)


sql_plan(
    "sql_cte",
    "with spend as (select o_custkey, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total from loaded_table group by 1), "
    "big as (select * from spend where total > 1000000) select c_mktsegment, count(*) as n from big join customer on o_custkey = c_custkey group by 1",
    "orders",
    ("customer",),
)
sql_plan(
    "sql_recursive",
    "with recursive counts as (select cast(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 as bigint) as q, count(*) as n from loaded_table group by 1), "
    "spine(q, last) as (select min(q), max(q) from counts union all select q + 1, last from spine where q < last) "
    "select spine.q, coalesce(n, 0) as n from spine left join counts on spine.q = counts.q",
    "orders",
)
sql_plan(
    "sql_subquery",
    "select o_orderkey, o_totalprice, (select count(*) from loaded_table) as all_orders from loaded_table o "
    "where o_totalprice > (select 1.5 * avg(o_totalprice) from loaded_table i where i.o_orderpriority = o.o_orderpriority)",
    "orders",
)
sql_plan(
    "sql_lateral",
    "select c_custkey, t.n, t.top from customer, lateral (select count(*) as n, max(o_totalprice) as top from loaded_table where o_custkey = c_custkey) t",
    "orders",
    ("customer",),
)
sql_plan(
    "sql_pivot",
    "select * from (select l_returnflag as flag, l_linestatus as status, l_orderkey from loaded_table) pivot (count(l_orderkey) for status in ('F' as f, 'O' as o))",
    "lineitem",
    oracle="select l_returnflag as flag, count(*) filter (where l_linestatus = 'F') as f, count(*) filter (where l_linestatus = 'O') as o from lineitem group by 1",
)
sql_plan(
    "sql_unpivot",
    "select * from (select p_partkey, cast(p_size as double) as p_size, p_retailprice from loaded_table) unpivot (value for name in (p_size, p_retailprice))",
    "part",
)
@plan("sql_sample_checked", "select true as about_a_tenth, true as all_known")
def sql_sample_checked(spark, sf_dir):
    """A sample of 10 percent has 7 to 13 % of the rows, and they are rows of the table.

    The second condition is `l_orderkey not in (select o_orderkey from orders)`, nulls included, spelled out: Spark runs NOT IN only by
    a broadcast of the whole list. The hint keeps a list that looks small by its compressed files from being broadcast all the same."""
    sql = (
        "select (select count(*) from loaded_table tablesample (10 percent) repeatable (7)) between 0.07 * count(*) and 0.13 * count(*) as about_a_tenth, "
        "(select /*+ merge(o) */ count(*) from (select distinct l_orderkey from loaded_table tablesample (10 percent) repeatable (7)) s "
        "left anti join (select distinct o_orderkey from orders) o on o_orderkey = l_orderkey "
        "where (l_orderkey is not null or not exists (select 1 from orders)) and not exists (select 1 from orders where o_orderkey is null)) = 0 as all_known from loaded_table"
    )
    return run_sql(table(spark, sf_dir, "lineitem"), sql, {"orders": table(spark, sf_dir, "orders")})


sql_plan("sql_sample", "select count(*) as n, avg(l_quantity) as avg_qty from loaded_table tablesample (10 percent) repeatable (7)", "lineitem", check=False)
sql_plan(
    "sql_string",
    "select c_custkey, upper(substring(c_name, 1, 4)) as head, replace(c_mktsegment, 'A', '*') as masked, split_part(c_name, '#', 2) as digits, "
    "lpad(cast(c_nationkey as varchar(10)), 5, '0') as padded, regexp_extract(c_name, '([1-9][0-9]*)$', 1) as tail, "
    "length(c_mktsegment) as len, reverse(c_mktsegment) as back, concat(c_name, '/', c_mktsegment) as both_names, instr(c_name, '#') as at from loaded_table",
    "customer",
    oracle="select c_custkey, upper(substring(c_name, 1, 4)) as head, replace(c_mktsegment, 'A', '*') as masked, split_part(c_name, '#', 2) as digits, "
    "lpad(cast(c_nationkey as varchar), 5, '0') as padded, regexp_extract(c_name, '([1-9][0-9]*)$', 1) as tail, "
    "cast(length(c_mktsegment) as int) as len, reverse(c_mktsegment) as back, concat(c_name, '/', c_mktsegment) as both_names, cast(instr(c_name, '#') as int) as at from customer",
)
sql_plan(
    "sql_date",
    "select o_orderkey, year(o_orderdate) as y, month(o_orderdate) as m, quarter(o_orderdate) as q, dayofyear(o_orderdate) as doy, "
    "dayofweek(o_orderdate) - 1 as dow, cast(date_trunc('month', o_orderdate) as date) as mth, cast(o_orderdate + interval 10 days as date) as later, "
    "datediff(date '2001-01-01', cast(o_orderdate as date)) as days_to from loaded_table",
    "orders",
    oracle="select o_orderkey, cast(year(o_orderdate) as int) as y, cast(month(o_orderdate) as int) as m, cast(quarter(o_orderdate) as int) as q, cast(dayofyear(o_orderdate) as int) as doy, "
    "cast(dayofweek(o_orderdate) as int) as dow, cast(date_trunc('month', o_orderdate) as date) as mth, cast(o_orderdate + interval 10 days as date) as later, "
    "cast(datediff('day', cast(o_orderdate as date), date '2001-01-01') as int) as days_to from orders",
)
sql_plan(
    "sql_math",
    "select c_custkey, abs(c_acctbal) as a, round(sqrt(abs(c_acctbal)), 6) as r, round(ln(abs(c_acctbal) + 1), 6) as l, "
    "round(power(c_acctbal / 1000, 2), 6) as p, c_custkey % 7 as m, cast(floor(c_acctbal) as bigint) as f, cast(ceil(c_acctbal) as bigint) as c, "
    "cast(sign(c_acctbal) as int) as s from loaded_table",
    "customer",
)
sql_plan(
    "sql_conditional",
    "select c_custkey, case when c_acctbal < 0 then 'debt' when c_acctbal < 5000 then 'low' else 'high' end as band, "
    "coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') as seg, greatest(c_acctbal, 100.0) as g, least(c_acctbal, 100.0) as l, "
    "c_acctbal is null as missing from loaded_table",
    "customer",
    oracle="select c_custkey, case when c_acctbal < 0 then 'debt' when c_acctbal < 5000 then 'low' else 'high' end as band, "
    "coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') as seg, greatest(c_acctbal, 100.0::double) as g, least(c_acctbal, 100.0::double) as l, "
    "c_acctbal is null as missing from customer",
)
sql_plan(
    "sql_list",
    "select doc_id, size(words) as n_words, array_contains(words, 'the') as has_the, size(array_distinct(words)) as n_distinct, "
    "array_join(transform(slice(words, 1, 3), w -> upper(w)), '+') as head from (select doc_id, split(replace(text, 'ß', 'ss'), ' ') as words from loaded_table)",
    "documents",
    oracle="select doc_id, cast(len(words) as int) as n_words, list_contains(words, 'the') as has_the, cast(len(list_distinct(words)) as int) as n_distinct, "
    "array_to_string(list_transform(words[1:3], lambda w: upper(w)), '+') as head from (select doc_id, string_split(replace(text, 'ß', 'ss'), ' ') as words from documents)",
)
sql_plan(
    "sql_explode",
    "select word, count(*) as n from (select explode(split(text, ' ')) as word from loaded_table) group by word",
    "documents",
    oracle="select word, count(*) as n from (select unnest(string_split(text, ' ')) as word from documents) group by word",
)
sql_plan(
    "sql_collect",
    # a set over the few event types, never a list of a user's rows
    "select user_id, array_join(array_sort(collect_set(event_type)), ',') as types from loaded_table group by user_id",
    "events",
    oracle="select user_id, string_agg(distinct event_type, ',' order by event_type) as types from events group by user_id",
)
sql_plan(
    "sql_map",
    "select user_id, size(map_keys(m)) as n_types, coalesce(try_element_at(m, 'click'), 0) as clicks, map_contains_key(m, 'error') as has_error from "
    "(select user_id, map_from_entries(collect_list(struct(event_type, n))) as m from "
    "(select user_id, event_type, count(*) as n from loaded_table group by 1, 2) group by user_id)",
    "events",
    oracle="select user_id, cast(count(distinct event_type) as int) as n_types, count(*) filter (where event_type = 'click') as clicks, "
    "bool_or(event_type = 'error') as has_error from events group by user_id",
)
sql_plan(
    "sql_json",
    "select event_type, cast(sum(cast(get_json_object(props, '$.k') as bigint)) as bigint) as total_k, max(from_json(props, 'k int').k) as top_k from loaded_table group by event_type",
    "events",
    oracle="select event_type, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as total_k, max(cast(json_extract_string(props, '$.k') as int)) as top_k from events group by event_type",
)
sql_plan(
    "sql_cast",
    "select o_orderkey, cast(o_orderkey as varchar(20)) as as_text, try_cast(o_orderpriority as int) as bad, try_cast(substring(o_orderpriority, 1, 1) as int) as level, "
    "cast(o_totalprice as decimal(18,2)) * 100 > 5000000 as big, o_custkey::double as key_d, cast(o_orderdate as date) as day from loaded_table",
    "orders",
)

# Row by row: the two fact tables meet on the order key, of which an order has at most a few lines.
_LINES = "l_orderkey, l_linenumber, l_quantity"
sql_plan("sql_join_rows_inner", f"select o_orderkey, o_custkey, {_LINES} from loaded_table join orders on l_orderkey = o_orderkey where o_orderstatus = 'F'", "lineitem", ("orders",))
sql_plan("sql_join_rows_left", f"select o_orderkey, {_LINES} from orders left join (select * from loaded_table where l_quantity > 48) l on o_orderkey = l_orderkey", "lineitem", ("orders",))
sql_plan(
    "sql_join_rows_full",
    f"select o_orderkey, {_LINES} from (select * from orders where o_orderstatus = 'F') o full join (select * from loaded_table where l_quantity > 45) l on o_orderkey = l_orderkey",
    "lineitem",
    ("orders",),
)
sql_plan("sql_join_rows_semi", "select o_orderkey, o_totalprice from orders where exists (select 1 from loaded_table where l_orderkey = o_orderkey and l_quantity > 49)", "lineitem", ("orders",))
sql_plan("sql_join_rows_anti", "select o_orderkey, o_totalprice from orders where not exists (select 1 from loaded_table where l_orderkey = o_orderkey and l_returnflag = 'R')", "lineitem", ("orders",))
_LINE_ORDER = "partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus"
sql_plan(
    "sql_window_rows",
    # several lines can share a number, so all columns together order them
    "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, cast(row_number() over w as bigint) as rn, lag(l_partkey) over w as before, lead(l_partkey) over w as after, "
    "cast(sum(cast(l_extendedprice as decimal(18,2))) over v as double) as running from loaded_table "
    f"window w as ({_LINE_ORDER}), v as ({_LINE_ORDER} rows between unbounded preceding and current row)",
    "lineitem",
)


@plan(
    "sql_join_interval_nulls",
    "select o_orderkey, (select count(*) from events where user_id = case when o_orderkey % 9 <> 0 then o_custkey end "
    "and event_id between case when o_orderkey % 5 <> 0 then o_orderkey end and case when o_orderkey % 7 <> 0 then o_orderkey + 400 else o_orderkey - 5 end) as n from orders",
)
def sql_join_interval_nulls(spark, sf_dir):
    """Intervals that are empty, or lack a bound or their key, hold nothing."""
    events = table(spark, sf_dir, "events").selectExpr("user_id as u", "event_id")
    asked = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "case when o_orderkey % 9 <> 0 then o_custkey end as u", "case when o_orderkey % 5 <> 0 then o_orderkey end as low",
        "case when o_orderkey % 7 <> 0 then o_orderkey + 400 else o_orderkey - 5 end as high",
    )
    return count_within(events, asked, "event_id", "low", "high", "o_orderkey", ["u"])


@plan(
    "sql_approx_distinct",
    "select count(distinct l_partkey) as exact_parts, count(distinct l_orderkey) as exact_orders, true as parts_near, true as orders_near from lineitem",
)
def sql_approx_distinct(spark, sf_dir):
    """The estimates, held against the exact numbers: within 5 %."""
    # each exact count by itself: beside a distinct count in one SELECT, Spark would keep an estimate's sketch of some KB for every distinct value
    sql = (
        "select exact_parts, exact_orders, abs(parts - exact_parts) <= 0.05 * exact_parts as parts_near, abs(orders - exact_orders) <= 0.05 * exact_orders as orders_near from "
        "(select (select count(l_partkey) from (select distinct l_partkey from loaded_table)) as exact_parts, "
        "(select count(l_orderkey) from (select distinct l_orderkey from loaded_table)) as exact_orders, "
        "approx_count_distinct(l_partkey, 0.015) as parts, approx_count_distinct(l_orderkey, 0.015) as orders from loaded_table)"
    )
    return run_sql(table(spark, sf_dir, "lineitem"), sql)


@plan(
    "sql_join_theta_long",
    "select s_suppkey, count(event_id) as n, sum(event_id)::double as total from (select s_suppkey, s_suppkey * 7 - 50 as low, case when s_suppkey % 17 = 0 then 1e300 "
    "else s_suppkey * 7 - 50 + power(2, s_suppkey % 15) end as high from supplier) s join events on event_id between low and high group by 1",
)
def sql_join_theta_long(spark, sf_dir):
    """Intervals from one place to the whole range, and some without an end."""
    low = F.col("s_suppkey") * 7 - 50
    high = F.when(F.col("s_suppkey") % 17 == 0, F.lit(float("inf"))).otherwise(low + F.pow(F.lit(2.0), F.col("s_suppkey") % 15))
    spans = table(spark, sf_dir, "supplier").select("s_suppkey", low.alias("low"), high.alias("high"))
    # an interval without an end holds most events, so their sums are joined, not the events
    events = table(spark, sf_dir, "events").where("event_id is not null").select("event_id", F.lit(1).cast("long").alias("one"))
    joined = range_join(events, spans, F.col("event_id"), F.col("low"), F.col("high"), 2, sums=["one", "event_id"])
    return joined.groupBy("s_suppkey").agg(F.sum("one").alias("n"), F.sum("event_id").cast("double").alias("total"))


_INTEGERS = {
    "l_orderkey": "l_orderkey", "l_partkey": "l_partkey", "l_suppkey": "l_suppkey", "l_linenumber": "l_linenumber",
    "quantity": "cast(l_quantity as bigint)", "below": "case when l_linenumber % 2 = 0 then 100 - l_partkey end",
}


@plan("sql_distinct_bitmap", " union all ".join(f"select '{name}' as \"column\", count(distinct {e}) as \"distinct\" from lineitem" for name, e in _INTEGERS.items()))
def sql_distinct_bitmap(spark, sf_dir):
    """Exact distinct counts of six columns from one scan."""
    return exact_distinct(table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} as {name}" for name, e in _INTEGERS.items()]), list(_INTEGERS))


_EVEN = "(('0x' || substr(md5(concat('{0}:', {1})), 1, 13))::bigint + 1) / power(2, 52)"


@plan("sample_by_key", f"select c_custkey, c_name, round({_EVEN.format(7, 'c_custkey')}, 9) as chance from customer order by {_EVEN.format(7, 'c_custkey')} limit 50")
def sample_by_key_plan(spark, sf_dir):
    """50 customers, the same on every run and in every engine."""
    return sample_by_key(table(spark, sf_dir, "customer"), "c_custkey", 50, seed="7").select("c_custkey", "c_name", F.round("chance", 9).alias("chance"))


@plan(
    "sample_weighted_by_group",
    f"select o_orderkey, o_orderpriority from orders qualify row_number() over (partition by o_orderpriority order by -ln({_EVEN.format(0, 'o_orderkey')}) / o_totalprice) <= 20",
)
def sample_weighted_by_group(spark, sf_dir):
    """20 orders of each priority, by their price."""
    return sample_by_key(table(spark, sf_dir, "orders"), "o_orderkey", 20, ["o_orderpriority"], "o_totalprice").select("o_orderkey", "o_orderpriority")
