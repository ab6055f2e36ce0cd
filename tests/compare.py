"""Rows of a Spark query and of its SQL in DuckDB, as comparable lists."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """A connection with one view for each table of sf_dir."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in sorted(os.listdir(sf_dir)):
        table, kind = os.path.splitext(name)
        if kind == ".parquet":
            path = f"{sf_dir}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{name}") else "")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    """A value that is equal in both engines: numbers to 9 digits, times without a zone."""
    if isinstance(value, decimal.Decimal | float):
        value = float(value)
        return "NaN" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, list | tuple):
        return tuple(plain(x) for x in value)
    return value


def rows(names: list[str], found: list) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def both(spark, con, query, sql: str, sf_dir: str) -> tuple[tuple, tuple]:
    """(column names, rows) of the Spark query and of the SQL."""
    df = query(spark, sf_dir)
    mine = df.collect()
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    return (sorted(df.columns), rows(df.columns, mine)), (sorted(names), rows(names, cursor.fetchall()))
