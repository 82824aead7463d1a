"""Rule validation: one aggregate for all rules, bounded samples, row-level violations."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.names import named
from ..functions.text import is_number, is_numeric_type, number_of, present, python_regex, python_text
from .skew import split_join

SAMPLE_ROWS = 3
DUPLICATE_EXAMPLES = 20
CHECKS_PER_PASS = 100
# The messages of a report, here and in compile_rules.
MISSING = "Missing required column or all values null"


@dataclass(frozen=True)
class Check:
    """One rule on one column. `bad` marks offending rows where a row alone can tell."""

    number: int
    column: str
    kind: str  # absent, required, type, min, max, regex, unique
    message: str
    bad: Column | None = None


def compile_rules(df: DataFrame, rules: dict[str, Any]) -> list[Check]:
    """Rules to checks, in rule order. Needs the schema only; no job runs.

    An absent column is one failed check if required and no check otherwise. A column that is
    all NULL fails `required` and cannot fail its other rules, which look at values only.
    """
    checks: list[Check] = []

    def add(column: str, kind: str, message: str, bad: Column | None = None) -> None:
        checks.append(Check(len(checks), column, kind, message, bad))

    for column, cfg in (rules.get("columns") or {}).items():
        if column not in df.columns:
            if cfg.get("required"):
                add(column, "absent", MISSING)
            continue
        if cfg.get("required"):
            add(column, "required", MISSING)
        value, kind = present(df, column), cfg.get("type")
        if kind in ("int", "float"):
            if not is_numeric_type(df.schema[column].dataType):
                add(column, "type", f"Type coercion to {kind} failed", value.isNotNull() & ~is_number(value.cast("string")))
            number = number_of(df, column)
            if cfg.get("min") is not None:
                add(column, "min", f"Values below min {cfg['min']}", number < F.lit(float(cfg["min"])))
            if cfg.get("max") is not None:
                add(column, "max", f"Values above max {cfg['max']}", number > F.lit(float(cfg["max"])))
        if cfg.get("regex"):
            bad = value.isNotNull() & ~_text_of(df, column).rlike(python_regex(cfg["regex"]))
            add(column, "regex", "Regex mismatch", bad)
        if cfg.get("unique"):
            add(column, "unique", "Duplicate values found")
    return checks


def _duplicated(df: DataFrame, column: str, order_by: str | None = None) -> DataFrame:
    """Each non-null value that occurs more than once: _value, _n rows, and its _first key.

    The filter names _first too, so that all uses of this table need the same shuffle, which
    Spark then runs once.
    """
    first = F.min(named(order_by)) if order_by else F.lit(0)
    return (
        df.select(present(df, column).alias("_value"), "*")
        .where(F.col("_value").isNotNull())
        .groupBy("_value")
        .agg(F.count(F.lit(1)).alias("_n"), first.alias("_first"))
        .where((F.col("_n") > 1) & (F.col("_first").isNotNull() | (F.col("_n") > 0)))
    )


def _unique_entries(df: DataFrame, checks: list[Check]) -> Column:
    """What the rows hold in the columns of the unique checks: an array of (check, value) without nulls, values as text."""

    def text(column: str) -> Column:
        value = present(df, column)
        if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
            value = F.when(value == 0, F.lit(0.0)).otherwise(value)  # 0.0 and -0.0 are one value
        return value.cast("string")

    entries = [F.struct(F.lit(c.number).alias("check"), text(c.column).alias("_value")) for c in checks]
    return F.filter(F.array(*entries), lambda e: e["_value"].isNotNull())


def _all_duplicated(df: DataFrame, checks: list[Check], order_by: str | None) -> DataFrame:
    """check, _value, _n rows and _first key of each value that occurs more than once, for all unique
    checks from one scan and one shuffle; copies of a value fold before it. As in _duplicated,
    both uses of this table need the same shuffle."""
    first = F.min("_key") if order_by else F.lit(0)
    key = named(order_by).alias("_key") if order_by else F.lit(0).alias("_key")
    rows = df.select(key, F.inline(_unique_entries(df, checks)))
    grouped = rows.groupBy("check", "_value").agg(F.count(F.lit(1)).alias("_n"), first.alias("_first"))
    return grouped.where((F.col("_n") > 1) & (F.col("_first").isNotNull() | (F.col("_n") > 0)))


def _text_of(df: DataFrame, column: str) -> Column:
    """The value as Python writes it."""
    value, dtype = present(df, column), df.schema[column].dataType
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return python_text(value)
    text = value.cast("string")
    return F.initcap(text) if isinstance(dtype, T.BooleanType) else text


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def check_counts(df: DataFrame, checks: list[Check], order_by: str | None = None) -> DataFrame:
    """One row per check: check, column, message, bad_rows (offending rows; 1 for required)."""

    def entry(check: Check, count: Column) -> Column:
        return F.struct(
            F.lit(check.number).alias("check"),
            F.lit(check.column).alias("column"),
            F.lit(check.message).alias("message"),
            F.coalesce(count, F.lit(0)).cast("bigint").alias("bad_rows"),
        )

    parts = []
    absent = [c for c in checks if c.kind == "absent"]
    if absent or not checks:
        one = df.sparkSession.range(1)
        entries = [entry(c, F.lit(1)) for c in absent]
        parts.append(one.select(F.inline(F.array(*entries))) if entries else _no_counts(df))
    shared = [c for c in checks if c.bad is not None or c.kind == "required"]
    for at in range(0, len(shared), CHECKS_PER_PASS):
        group = shared[at : at + CHECKS_PER_PASS]
        figures = [
            (
                (F.count(present(df, c.column)) == 0).cast("bigint") if c.kind == "required" else F.count_if(c.bad)
            ).alias(f"c{c.number}")
            for c in group
        ]
        entries = [entry(c, F.col(f"c{c.number}")) for c in group]
        parts.append(df.agg(*figures).select(F.inline(F.array(*entries))))
    unique = [c for c in checks if c.kind == "unique"]
    if unique:
        sums = [F.sum(F.when(F.col("check") == c.number, F.col("_n"))).alias(f"c{c.number}") for c in unique]
        members = _all_duplicated(df, unique, order_by).agg(*sums)
        parts.append(members.select(F.inline(F.array(*[entry(c, F.col(f"c{c.number}")) for c in unique]))))
    return _union(parts)


def _no_counts(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "check int, column string, message string, bad_rows bigint")


def check_samples(df: DataFrame, checks: list[Check], order_by: str) -> DataFrame:
    """One row per check with offenders: check, row_sample = its first 3 (row_id, value) by key.

    A failed type check samples the first rows of the column, all others their offending rows.
    """
    key = named(order_by).alias("row_id")

    def entry(check: Check) -> Column:
        return F.struct(F.lit(check.number).alias("check"), named(check.column).cast("string").alias("value"))

    by_row = [c for c in checks if c.kind in ("min", "max", "regex")]
    by_type = [c for c in checks if c.kind == "type"]
    unique = [c for c in checks if c.kind == "unique"]
    parts = []
    if by_row or unique:
        found = F.array_compact(F.array(*[F.when(c.bad, entry(c)) for c in by_row])) if by_row else None
        if unique:
            # the first 3 members of a check belong to the 3 values whose first members come first
            rank = F.row_number().over(W.partitionBy("check").orderBy("_first"))
            early = _all_duplicated(df, unique, order_by).withColumn("_rank", rank).where(F.col("_rank") <= SAMPLE_ROWS)
            df = df.withColumn("_early", early.agg(F.collect_set(F.struct("check", "_value"))).scalar())  # at most 3 values a check
            wanted = F.filter(_unique_entries(df, unique), lambda e: F.array_contains("_early", e))
            members = F.transform(wanted, lambda e: F.struct(e["check"].alias("check"), e["_value"].alias("value")))
            found = members if found is None else F.concat(found, members)
        # the rank filter is applied on each input partition first: 3 rows per check are shuffled
        offenders = df.select(key, F.inline(found))
        rank = F.row_number().over(W.partitionBy("check").orderBy("row_id"))
        parts.append(offenders.withColumn("_rank", rank).where(F.col("_rank") <= SAMPLE_ROWS).drop("_rank"))
    if by_type:
        head = df.orderBy(named(order_by)).limit(SAMPLE_ROWS)
        parts.append(head.select(named(order_by).alias("row_id"), F.inline(F.array(*[
            F.struct(F.lit(c.number).alias("check"), named(c.column).cast("string").alias("value")) for c in by_type
        ]))))
    if not parts:
        dtype = df.schema[order_by].dataType
        schema = T.StructType([T.StructField("row_id", dtype)]).add("check", "int").add("value", "string")
        parts.append(df.sparkSession.createDataFrame([], schema))
    sample = F.array_sort(F.collect_list(F.struct("row_id", "value"))).alias("row_sample")
    return _union(parts).groupBy("check").agg(sample)


def with_row_id(df: DataFrame, name: str = "_row_id") -> DataFrame:
    """A row key for tables without one: increasing in file order, not contiguous."""
    return df.withColumn(name, F.monotonically_increasing_id())


def validation_report(df: DataFrame, rules: dict[str, Any], order_by: str) -> DataFrame:
    """One row per failed rule: check, column, message, bad_rows, row_sample."""
    checks = compile_rules(df, rules)
    samples = F.broadcast(check_samples(df, checks, order_by))  # at most 3 rows per rule
    return check_counts(df, checks, order_by).where("bad_rows > 0").join(samples, "check", "left")


def _as_type(value: str | None, dtype: T.DataType):
    """A sampled value, which is text, back in its column's type."""
    if value is None or isinstance(dtype, T.StringType):
        return value
    if isinstance(dtype, T.BooleanType):
        return value == "true"
    if isinstance(dtype, T.IntegralType):
        return int(value)
    return float(value) if isinstance(dtype, (T.FloatType, T.DoubleType)) else value


def validate_dataframe(df: DataFrame, rules: dict[str, Any], order_by: str | None = None) -> dict[str, Any]:
    """The report as {"errors": [...], "summary": {"error_count": n}}; samples only for failures."""
    if order_by is None:
        order_by, df = "_row_id", with_row_id(df)
    checks = compile_rules(df, rules)
    failed = {r["check"] for r in check_counts(df, checks).where("bad_rows > 0").collect()}
    failing = [c for c in checks if c.number in failed]
    sampled = [c for c in failing if c.kind not in ("absent", "required")]
    samples = {}
    if sampled:
        types = {c.number: df.schema[c.column].dataType for c in sampled}
        for r in check_samples(df, sampled, order_by).collect():
            n = r["check"]
            samples[n] = {s["row_id"]: _as_type(s["value"], types[n]) for s in r["row_sample"]}
    errors = [
        {"column": c.column, "message": c.message, "row_sample": samples.get(c.number, {})} for c in failing
    ]
    return {"errors": errors, "summary": {"error_count": len(errors)}}


def violating_rows(df: DataFrame, rules: dict[str, Any], order_by: str) -> DataFrame:
    """One row per offending row and rule: row_id, column, message."""
    checks = compile_rules(df, rules)

    def entry(c: Check) -> Column:
        return F.struct(F.lit(c.column).alias("column"), F.lit(c.message).alias("message"))

    parts = []
    by_row = [c for c in checks if c.bad is not None]
    if by_row:
        found = F.array_compact(F.array(*[F.when(c.bad, entry(c)) for c in by_row]))
        parts.append(df.select(named(order_by).alias("row_id"), F.inline(found)))
    for c in checks:
        if c.kind == "unique":
            rows = df.select(named(order_by).alias("row_id"), present(df, c.column).alias("_value"))
            rows = rows.where(F.col("_value").isNotNull())
            members = split_join(rows, _duplicated(df, c.column).drop("_first"), ["_value"], "_n")
            parts.append(members.select("row_id", F.inline(F.array(entry(c)))))
    if not parts:
        dtype = df.schema[order_by].dataType
        schema = T.StructType([T.StructField("row_id", dtype)]).add("column", "string").add("message", "string")
        return df.sparkSession.createDataFrame([], schema)
    return _union(parts)


def repeated_rows(df: DataFrame, column: str, order_by: str) -> DataFrame:
    """Second and later rows of each value, NULL counting as a value; `order_by` must be unique.

    Each value's first key is found by grouping, then these keys are taken out. That join runs
    on the unique key, so no value, however frequent, gathers in one task.
    """
    first = df.groupBy(present(df, column).alias("_value")).agg(F.min(named(order_by)).alias("_first"))
    return df.join(first.select("_first"), named(order_by) == F.col("_first"), "left_anti")


def unique_examples(df: DataFrame, column: str, order_by: str, limit: int = DUPLICATE_EXAMPLES) -> DataFrame:
    """The first `limit` second and later rows. Only rows whose value occurs more than once are looked at; of one
    value its first limit + 1 rows at most can be among them, so no value gathers in one task."""
    rows = df.select(named(order_by), named(column), present(df, column).alias("_value"))
    sizes = rows.groupBy("_value").agg(F.count(F.lit(1)).alias("_n"), F.min(named(order_by)).alias("_first")).where(F.col("_n") > 1)
    # the values of the first `limit` later rows are among those with the earliest first rows
    early = sizes.orderBy("_first").limit(limit)
    members = rows.join(F.broadcast(early), rows["_value"].eqNullSafe(early["_value"])).where(named(order_by) > F.col("_first"))
    return members.orderBy(named(order_by)).limit(limit).select(named(order_by), named(column))


def list_rules_report(df: DataFrame, rules: dict[str, Any], order_by: str) -> dict[str, Any]:
    """Rules given as lists ("required", "unique"): {"ok": bool, "issues": [...]}."""
    issues: list[dict[str, Any]] = [
        {"type": "missing_column", "column": c} for c in rules.get("required", []) if c not in df.columns
    ]
    for column in rules.get("unique", []):
        if column in df.columns:
            rows = unique_examples(df, column, order_by).collect()
            if rows:
                issues.append({"type": "duplicate_values", "column": column, "examples": [r[column] for r in rows]})
    return {"ok": not issues, "issues": issues}
