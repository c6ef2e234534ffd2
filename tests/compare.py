"""Compare a Spark result with a DuckDB result, value by value."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, bool):
        return value
    if isinstance(value, dict):
        return {k: plain(v) for k, v in sorted(value.items())}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def spark_rows(df):
    return normal(df.columns, [tuple(row) for row in df.collect()])


def duck_rows(con, sql):
    result = con.sql(sql)
    return normal(result.columns, result.fetchall())


def difference(df, con, sql) -> str | None:
    """None if both agree, else a short text that says how they differ."""
    spark_columns, mine = spark_rows(df)
    duck_columns, theirs = duck_rows(con, sql)
    if spark_columns != duck_columns:
        return f"columns {spark_columns} against {duck_columns}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}; {[r for r in mine if r not in theirs][:2]} / {[r for r in theirs if r not in mine][:2]}"
    for a, b in zip(mine, theirs):
        if repr(a) != repr(b):
            return f"{a} against {b}"
    return None
