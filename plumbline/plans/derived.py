"""Tables with defects, derived from the given ones; the same text serves Spark and the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import resample
from ..sources.rulefile import load_rules
from .registry import table

DIRTY_COLUMNS = {
    "c_custkey": "c_custkey",
    "name": "case when c_custkey % 11 = 0 then cast(null as string) else concat('  ', c_name, chr(9)) end",
    "age": "case when c_custkey % 13 = 0 then cast(null as int) when c_custkey % 50 = 1 then -5 "
    "when c_custkey % 50 = 2 then 200 else cast(c_custkey % 90 as int) end",
    "email": "case when c_custkey % 17 = 0 then 'invalid' when c_custkey % 19 = 0 then cast(null as string) "
    "else concat('user', cast(c_custkey % 1400 as string), '@example.com') end",
    "code": "case when c_custkey % 23 = 0 then 'n/a?' else cast(c_custkey as string) end",
}
DIRTY_SQL = "select " + ", ".join(f"{e} as {n}" for n, e in DIRTY_COLUMNS.items()) + " from customer"
WITH_DIRTY = f"with dirty as ({DIRTY_SQL}) "
WITH_COPIES = (
    f"with dirty as ({DIRTY_SQL}), "
    "copies as (select * from dirty union all select * from dirty where c_custkey % 5 = 0) "
)
WITH_DAILY = "with daily as (select date_trunc('day', o_orderdate) as ts, sum(o_totalprice) as value from orders group by 1) "

_SAMPLE = load_rules("rules/basic.yaml")["columns"]
RULES = {
    "columns": {
        **_SAMPLE,
        "email": {**_SAMPLE["email"], "unique": True},
        "code": {"type": "int"},
        "c_custkey": {"unique": True},
        "phone": {"required": True},
    }
}


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*[f"{e} as {n}" for n, e in DIRTY_COLUMNS.items()])


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dirty(spark, sf_dir)
    return rows.unionByName(rows.where(F.col("c_custkey") % 5 == 0))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "D")
