"""Profiling, validation and cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.anomaly import analysis_context, zscore
from ..operators.clean import clean, clean_counts
from ..operators.distinct import repeated_values
from ..operators.profilestate import merge_states, profile_of, profile_state
from ..operators.profile import column_profile, display_profile, first_rows, random_rows, summarize, table_shape
from ..operators.validate import (
    check_counts,
    check_samples,
    compile_rules,
    list_rules_report,
    unique_examples,
    validation_report,
    violating_rows,
)
from ..session import scratch_dir
from .derived import RULES, WITH_COPIES, WITH_DIRTY, copies, dirty
from .registry import plan, table

NUMERIC = {
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
}


def _union_sql(parts: list[str]) -> str:
    return " union all ".join(parts)


@plan("profile_rows", "select count(*) as row_count from lineitem")
def profile_rows(spark, sf_dir):
    return table_shape(table(spark, sf_dir, "lineitem")).select(F.col("rows").alias("row_count"))


@plan("profile_shape", "select count(*) as row_count, 11 as col_count from lineitem")
def profile_shape(spark, sf_dir):
    return table_shape(table(spark, sf_dir, "lineitem")).toDF("row_count", "col_count")


@plan(
    "profile_nulls",
    WITH_DIRTY
    + _union_sql(
        [
            f"select '{c}' as name, count(*) - count({c}) as null_count, "
            f"round((count(*) - count({c})) / greatest(count(*), 1), 6) as null_pct from dirty"
            for c in ("c_custkey", "name", "age", "email", "code")
        ]
    ),
)
def profile_nulls(spark, sf_dir):
    return column_profile(dirty(spark, sf_dir)).select("name", "null_count", F.round("null_pct", 6).alias("null_pct"))


@plan(
    "profile_numeric",
    _union_sql(
        [
            f"select '{c}' as name, cast(min({c}) as double) as min, cast(max({c}) as double) as max, "
            f"round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std from lineitem"
            for c in NUMERIC["lineitem"]
        ]
    ),
)
def profile_numeric(spark, sf_dir):
    profile = column_profile(table(spark, sf_dir, "lineitem")).where("mean is not null")
    return profile.select("name", "min", "max", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


def _report_sql(position: int, name: str, dtype: str, numeric: bool) -> str:
    stats = (
        f"cast(min({name}) as double) as min, cast(max({name}) as double) as max, "
        f"round(avg({name}), 4) as mean, round(stddev_samp({name}), 4) as std"
        if numeric
        else "cast(null as double) as min, cast(null as double) as max, cast(null as double) as mean, cast(null as double) as std"
    )
    nulls = f"count(*) - count({name})"
    return (
        f"select {position} as position, '{name}' as name, '{dtype}' as type, {nulls} as null_count, "
        f"round(100 * ({nulls}) / greatest(count(*), 1), 1) as null_pct_shown, {stats} from dirty"
    )


@plan(
    "profile_report",
    WITH_DIRTY
    + _union_sql(
        [
            _report_sql(0, "c_custkey", "bigint", True),
            _report_sql(1, "name", "string", False),
            _report_sql(2, "age", "int", True),
            _report_sql(3, "email", "string", False),
            _report_sql(4, "code", "string", False),
        ]
    ),
)
def profile_report(spark, sf_dir):
    shown = display_profile(column_profile(dirty(spark, sf_dir)))
    return shown.select(
        "position", "name", "type", "null_count", "null_pct_shown", "min", "max",
        F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"),
    )


@plan("profile_sample", "select * from orders order by o_orderkey limit 20")
def profile_sample(spark, sf_dir):
    return first_rows(table(spark, sf_dir, "orders"), "o_orderkey")


@plan("sample_random")
def sample_random(spark, sf_dir):
    return random_rows(table(spark, sf_dir, "orders"))


@plan(
    "sql_summarize",
    _union_sql(
        [
            f"select '{c}' as column_name, cast(min({c}) as varchar) as min, cast(max({c}) as varchar) as max, "
            + (f"round(avg({c}), 4) as avg, round(stddev_samp({c}), 4) as std, " if numeric
               else "cast(null as double) as avg, cast(null as double) as std, ")
            + f"count(*) as count, round(100.0 * (count(*) - count({c})) / count(*), 4) as null_percentage from part"
            for c, numeric in (("p_partkey", True), ("p_name", False), ("p_brand", False), ("p_type", False), ("p_size", True), ("p_retailprice", True))
        ]
    ),
)
def sql_summarize(spark, sf_dir):
    """The exact columns of the summary; approximate ones have no exact counterpart."""
    return summarize(table(spark, sf_dir, "part")).select(
        "column_name", "min", "max", F.round("avg", 4).alias("avg"), F.round("std", 4).alias("std"),
        "count", F.round("null_percentage", 4).alias("null_percentage"),
    )


@plan("sql_summarize_approx")
def sql_summarize_approx(spark, sf_dir):
    return summarize(table(spark, sf_dir, "lineitem"))


ZSCORE_SQL = (
    "select event_id, ts, event_type, value, (value - m) / s as score from events, "
    "(select avg(value) as m, stddev_samp(value) as s from events) where abs((value - m) / s) > 3"
)


@plan(
    "analysis_context",
    f"with z as ({ZSCORE_SQL}) select count(*) as row_count, 6 as col_count, 'ts' as date_col, 'value' as value_col, "
    "(select count(*) from z) as anomalies_count, "
    "(select round(sum(value), 6) from (select value from z order by ts, value limit 20)) as preview_sum from events",
)
def analysis_context_plan(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    context = analysis_context(events, zscore(events, "value"), "ts", "value")
    preview = F.aggregate("anomalies_preview", F.lit(0.0), lambda total, point: total + point["value"])
    return context.select(
        F.col("rows").alias("row_count"), F.col("cols").alias("col_count"), "date_col", "value_col",
        "anomalies_count", F.round(preview, 6).alias("preview_sum"),
    )


def _counts(name: str, rules: dict, oracle: str) -> None:
    """Query: the failed rules among `rules` on the dirty table."""

    @plan(name, WITH_DIRTY + oracle)
    def fn(spark, sf_dir):
        rows = dirty(spark, sf_dir).withColumn("ghost", F.lit(None).cast("string"))
        counts = check_counts(rows, compile_rules(rows, {"columns": rules}))
        return counts.where("bad_rows > 0").drop("check")


NUMBER_SQL = r"'(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)$'"
EMAIL = RULES["columns"]["email"]["regex"]

_counts(
    "rule_required_allnull",
    {"ghost": {"required": True}, "name": {"required": True}},
    "select 'ghost' as \"column\", 'Missing required column or all values null' as message, "
    "cast(1 as bigint) as bad_rows from dirty having count(name) > 0",
)
_counts(
    "rule_required_missing",
    {"phone": {"required": True}, "fax": {"regex": "x"}, "name": {"required": True}},
    "select 'phone' as \"column\", 'Missing required column or all values null' as message, "
    "cast(1 as bigint) as bad_rows from dirty having count(name) > 0",
)
_counts(
    "rule_type_int",
    {"code": {"type": "int"}, "age": {"type": "int"}},
    "select 'code' as \"column\", 'Type coercion to int failed' as message, count(*) as bad_rows "
    f"from dirty where not regexp_matches(trim(code), {NUMBER_SQL})",
)
_counts(
    "rule_type_float",
    {"email": {"type": "float"}, "code": {"type": "float"}},
    "select c as \"column\", 'Type coercion to float failed' as message, count(*) as bad_rows from "
    "(select 'code' as c, code as v from dirty union all select 'email', email from dirty) "
    f"where not regexp_matches(trim(v), {NUMBER_SQL}) group by 1",
)
_counts(
    "rule_min",
    {"age": {"type": "int", "min": 0}},
    "select 'age' as \"column\", 'Values below min 0' as message, count(*) as bad_rows from dirty where age < 0",
)
_counts(
    "rule_max",
    {"age": {"type": "int", "max": 120}, "code": {"type": "float", "max": 100.5}},
    "select 'age' as \"column\", 'Values above max 120' as message, count(*) as bad_rows from dirty where age > 120 "
    "union all select 'code', 'Values above max 100.5', count(*) from dirty where try_cast(code as double) > 100.5 "
    "union all select 'code', 'Type coercion to float failed', count(*) from dirty where try_cast(code as double) is null",
)
_counts(
    "rule_regex",
    {"email": {"regex": EMAIL}},
    f"select 'email' as \"column\", 'Regex mismatch' as message, count(*) as bad_rows from dirty where not regexp_matches(email, '{EMAIL}')",
)
_counts(
    "rule_unique",
    {"age": {"unique": True}, "c_custkey": {"unique": True}},
    "select 'age' as \"column\", 'Duplicate values found' as message, cast(sum(n) as bigint) as bad_rows from "
    "(select count(*) as n from dirty where age is not null group by age having count(*) > 1)",
)


@plan(
    "rule_regex_pages",
    "select count(*) as bad_rows from pages where not regexp_matches(url, '^https?://[a-z]+\\.example\\.(com|org)/')",
)
def rule_regex_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    checks = compile_rules(pages, {"columns": {"url": {"regex": r"https?://[a-z]+\.example\.(com|org)/"}}})
    return check_counts(pages, checks).select("bad_rows")


_BAD_SQL = (
    "bad as (select 1 as chk, 'age' as col, 'Values below min 0' as msg, c_custkey as row_id, cast(age as varchar) as v, true as counted from dirty where age < 0 "
    "union all select 2, 'age', 'Values above max 120', c_custkey, cast(age as varchar), true from dirty where age > 120 "
    f"union all select 3, 'email', 'Regex mismatch', c_custkey, email, true from dirty where not regexp_matches(email, '{EMAIL}') "
    "union all select 4, 'email', 'Duplicate values found', c_custkey, email, true from dirty where email in "
    "(select email from dirty where email is not null group by email having count(*) > 1) "
    f"union all select 5, 'code', 'Type coercion to int failed', c_custkey, code, true from dirty where not regexp_matches(trim(code), {NUMBER_SQL}))"
)
_SAMPLES_SQL = (
    "shown as (select chk, row_id, v from bad where chk <> 5 union all select 5, c_custkey, code from dirty where exists (select 1 from bad where chk = 5)), "
    "ranked as (select *, row_number() over (partition by chk order by row_id) as rn from shown)"
)


@plan(
    "violation_samples",
    WITH_DIRTY.rstrip() + f", {_BAD_SQL}, {_SAMPLES_SQL} select chk as check_no, row_id, v as value from ranked where rn <= 3",
)
def violation_samples(spark, sf_dir):
    rows = dirty(spark, sf_dir)
    samples = check_samples(rows, compile_rules(rows, RULES), "c_custkey")
    return samples.select(F.col("check").alias("check_no"), F.inline("row_sample"))


@plan(
    "validate_report",
    WITH_DIRTY.rstrip()
    + f", {_BAD_SQL}, {_SAMPLES_SQL}, ids as (select chk, string_agg(cast(row_id as varchar), ',' order by row_id) as sample_ids from ranked where rn <= 3 group by 1) "
    'select col as "column", msg as message, count(*) as bad_rows, min(sample_ids) as sample_ids from bad join ids using (chk) group by 1, 2 '
    "union all select 'phone', 'Missing required column or all values null', 1, null",
)
def validate_report(spark, sf_dir):
    """Flagship: all rules of one rule set on one table, with counts and samples."""
    report = validation_report(dirty(spark, sf_dir), RULES, "c_custkey")
    ids = F.transform("row_sample", lambda r: r["row_id"].cast("string"))
    return report.select(
        "column", "message", "bad_rows", F.when(F.col("row_sample").isNotNull(), F.array_join(ids, ",")).alias("sample_ids")
    )


@plan(
    "violating_rows",
    WITH_DIRTY.rstrip() + f', {_BAD_SQL} select row_id, col as "column", msg as message from bad',
)
def violating_rows_plan(spark, sf_dir):
    return violating_rows(dirty(spark, sf_dir), RULES, "c_custkey")


@plan(
    "unique_examples",
    WITH_DIRTY
    + "select c_custkey, email from (select *, row_number() over (partition by email order by c_custkey) as rn from dirty) "
    "where rn > 1 order by c_custkey limit 20",
)
def unique_examples_plan(spark, sf_dir):
    return unique_examples(dirty(spark, sf_dir), "email", "c_custkey")


@plan("clean_trim", WITH_DIRTY + "select c_custkey, trim(name, concat(' ', chr(9))) as name, age, email, code from dirty")
def clean_trim(spark, sf_dir):
    return clean(dirty(spark, sf_dir))


@plan("clean_lower", "select doc_id, lower(text) as text, lower(lang) as lang, lower(source) as source, n_chars from documents")
def clean_lower(spark, sf_dir):
    return clean(table(spark, sf_dir, "documents"), trim=False, normalize_case="lower")


@plan("clean_upper", "select doc_id, upper(replace(text, 'ß', 'ss')) as text, upper(lang) as lang, upper(source) as source, n_chars from documents")
def clean_upper(spark, sf_dir):
    return clean(table(spark, sf_dir, "documents"), trim=False, normalize_case="upper")


@plan("clean_dedup", WITH_COPIES + "select distinct * from copies")
def clean_dedup(spark, sf_dir):
    return clean(copies(spark, sf_dir), trim=False, drop_duplicates=True)


@plan("clean_dedup_text", "select distinct lang, text from documents")
def clean_dedup_text(spark, sf_dir):
    return clean(table(spark, sf_dir, "documents").select("lang", "text"), trim=False, drop_duplicates=True)


_CLEANED = "select distinct c_custkey, lower(trim(name, concat(' ', chr(9)))) as name, age, lower(email) as email, lower(code) as code from copies"


@plan("clean_full", WITH_COPIES + _CLEANED)
def clean_full(spark, sf_dir):
    return clean(copies(spark, sf_dir), normalize_case="lower", drop_duplicates=True)


@plan("clean_counts", WITH_COPIES + f"select (select count(*) from copies) as before, count(*) as after from ({_CLEANED})")
def clean_counts_plan(spark, sf_dir):
    return clean_counts(copies(spark, sf_dir), normalize_case="lower", drop_duplicates=True)


@plan("sample_random_checked", "select 50::bigint as n, 50::bigint as different, 50::bigint as known")
def sample_random_checked(spark, sf_dir):
    """50 rows, no row twice, all of them rows of the table."""
    orders = table(spark, sf_dir, "orders")
    drawn = random_rows(orders)
    known = drawn.join(orders, drawn.columns, "left_semi").agg(F.count(F.lit(1)))
    return drawn.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("different")).withColumn("known", known.scalar())


@plan(
    "sql_summarize_checked",
    "select * from (values ('l_partkey', true, true), ('l_extendedprice', true, true), ('l_quantity', true, true)) as t(column_name, distinct_near, quartiles_near)",
)
def sql_summarize_checked(spark, sf_dir):
    """The approximate figures of the summary, held against the exact ones: distinct numbers within a tenth, a
    quartile with between 24 and 26 % (49 to 51, 74 to 76) of the rows below or at it."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice", "l_quantity")
    summary = summarize(rows)
    exact = None
    for name in rows.columns:
        own = summary.where(F.col("column_name") == name).select(F.struct("approx_unique", "q25", "q50", "q75")).scalar()
        v, n = F.col(name), F.count(F.lit(1))
        spread = [(F.count_if(v < own[q]) / n <= p + 0.01) & (F.count_if(v <= own[q]) / n >= p - 0.01) for q, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))]
        near = F.abs(own["approx_unique"] - F.countDistinct(v)) <= 0.1 * F.countDistinct(v)
        part = rows.agg(near.alias("distinct_near"), (spread[0] & spread[1] & spread[2]).alias("quartiles_near"))
        part = part.select(F.lit(name).alias("column_name"), "distinct_near", "quartiles_near")
        exact = part if exact is None else exact.unionByName(part)
    return exact


@plan(
    "rule_regex_double",
    "select count(*) as bad_rows from part where not (p_retailprice * 100000 >= 10000000 and p_retailprice * 100000 < 100000000)",
)
def rule_regex_double(spark, sf_dir):
    """Large doubles are matched as Python writes them, in plain digits."""
    rows = table(spark, sf_dir, "part").select((F.col("p_retailprice") * 100000).alias("v"))
    return check_counts(rows, compile_rules(rows, {"columns": {"v": {"regex": r"^\d{8}\.\d+$"}}})).select("bad_rows")


@plan("rule_unique_text", "select doc_id, count(*) over (partition by text) as n from documents where text is not null qualify n > 1")
def rule_unique_text(spark, sf_dir):
    """Documents whose whole text occurs more than once; texts that do not are never shuffled."""
    return repeated_values(table(spark, sf_dir, "documents"), "text", "doc_id")


@plan(
    "list_rules_issues",
    "select 'missing_column' as type, 'no_such_column' as \"column\", null::varchar as example union all "
    "select 'duplicate_values', 'c_mktsegment', c_mktsegment from (select c_mktsegment from (select c_custkey, c_mktsegment, "
    "row_number() over (partition by c_mktsegment order by c_custkey) as i from customer) where i > 1 order by c_custkey limit 20)",
)
def list_rules_issues(spark, sf_dir):
    """Rules given as lists: one row per missing column and per example of a repeated value; a unique key has none."""
    rules = {"required": ["c_custkey", "no_such_column"], "unique": ["c_custkey", "c_mktsegment"]}
    report = list_rules_report(table(spark, sf_dir, "customer"), rules, "c_custkey")
    rows = [(i["type"], i["column"], e) for i in report["issues"] for e in i.get("examples", [None])]
    return spark.createDataFrame(rows if not report["ok"] else [], "type string, column string, example string")


_MERGED = {"o_orderkey": True, "o_custkey": True, "o_orderstatus": False, "o_totalprice": True, "o_orderpriority": False}


@plan(
    "profile_merged",
    " union all ".join(
        f"select '{c}' as name, count(*) as rows, count(*) - count({c}) as null_count, min({c})::varchar as min, max({c})::varchar as max, "
        + (f"round(avg({c}), 4) as mean, round(stddev_samp({c}), 3) as std" if numeric else "null::double as mean, null::double as std")
        + f", true as quartiles_near, true as distinct_near from orders"
        for c, numeric in _MERGED.items()
    ).replace("min(o_totalprice)::varchar", "null::varchar").replace("max(o_totalprice)::varchar", "null::varchar"),
)
def profile_merged(spark, sf_dir):
    """The profile of parts that arrived one by one, from their stored states: one for each order status; the sketches are
    held against the exact figures of the whole."""
    orders, path = table(spark, sf_dir, "orders"), scratch_dir(spark, "profile_states")
    for status in ("F", "O", "P"):  # three arrivals, one scan each
        profile_state(orders.where(F.col("o_orderstatus") == status).select(*_MERGED)).write.mode("append").parquet(path)
    merged = profile_of(merge_states(spark.read.parquet(path)))
    numbers = [c for c, numeric in _MERGED.items() if numeric]
    exact = orders.agg(F.create_map(*[x for c in _MERGED for x in (F.lit(c), F.count_distinct(c))]))
    distinct = F.element_at(exact.scalar(), F.col("name"))
    near = F.abs(F.col("approx_distinct") - distinct) <= 0.04 * distinct + 1
    below = merged.where(F.col("q25").isNotNull()).select("name", F.array("q25", "q50", "q75").alias("qs"))
    cells = orders.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in numbers])))
    ranks = cells.join(F.broadcast(below), "name").groupBy("name", "qs").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("v") <= F.col("qs")[i]).alias(f"r{i}") for i in range(3)])
    good = ranks.select("name", F.forall(F.array(*[F.abs(F.col(f"r{i}") / F.col("n") - 0.25 * (i + 1)) for i in range(3)]), lambda x: x <= 0.01).alias("good"))
    shown = [F.when(F.col("name") != "o_totalprice", F.col(c)).alias(c) for c in ("min", "max")]
    joined = merged.join(good, "name", "left")
    return joined.select("name", "rows", "null_count", *shown, F.round("mean", 4).alias("mean"), F.round("std", 3).alias("std"), F.coalesce("good", F.lit(True)).alias("quartiles_near"), near.alias("distinct_near"))
