"""Compare a Spark result with DuckDB's for the same tables: columns, row count, values."""

from __future__ import annotations

import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    return repr(v)


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def _kind(dtype: str) -> str:
    dtype = dtype.lower()
    aliases = {"long": "bigint", "integer": "int", "string": "varchar", "timestamp_ntz": "timestamp"}
    return aliases.get(dtype, dtype).split("(")[0]


def differences(df, con, sql: str) -> str | None:
    """None if equal, else what differs first."""
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    types = {d[0]: _kind(str(d[1])) for d in want.description}
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    wrong = {f.name: (f.dataType.simpleString(), types[f.name]) for f in df.schema if _kind(f.dataType.simpleString()) != types[f.name]}
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    expected = _rows(names, want.fetchall())
    if len(got) != len(expected):
        return f"{len(got)} rows != {len(expected)}"
    for a, b in zip(got, expected):
        if a != b:
            return f"{sorted(names)}: {str(a)[:400]} != {str(b)[:400]}"
    return f"types {wrong}" if wrong else None
