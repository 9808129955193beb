"""Order-insensitive comparison of a Spark result with the DuckDB result of its SQL counterpart."""

from __future__ import annotations

import math

import duckdb

from catalog.standins import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _normal(value):
    if isinstance(value, float):
        assert not math.isnan(value)
        return 0.0 if value == 0 else value
    return value


def _ordered(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(_normal(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(table, key=repr)


def spark_rows(df):
    return _ordered(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql: str):
    result = con.sql(sql)
    return _ordered(result.columns, result.fetchall())


def difference(df, con, sql: str) -> str:
    """Empty when both results are equal, else what differs first."""
    (ours, left), (theirs, right) = spark_rows(df), sql_rows(con, sql)
    if ours != theirs:
        return f"columns {ours} != {theirs}"
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)}"
    unequal = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(unequal)} unequal rows, first {str(unequal[0])[:1500]}" if unequal else ""
