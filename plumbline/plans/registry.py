"""The list of named queries with, where SQL can say it, the same result in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.sqlrun import VIEW, run_sql

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plan(name: str, oracle: str | None = None) -> Callable[[Plan], Plan]:
    def keep(fn: Plan) -> Plan:
        PLANS[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return keep


def sql_plan(name: str, sql: str, loaded: str, others: tuple[str, ...] = (), oracle: str | None = None, check: bool = True) -> None:
    """A query given as Spark SQL over `loaded_table`; the oracle is the same text unless given."""

    def fn(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = {t: table(spark, sf_dir, t) for t in others}
        return run_sql(table(spark, sf_dir, loaded), sql, tables)

    PLANS[name] = fn
    if check:
        ORACLES[name] = (oracle or sql).replace(VIEW, loaded)
