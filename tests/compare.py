"""Runs a query and its SQL on the same tables and compares the rows without regard to order."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, decimal.Decimal)):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    if hasattr(value, "asDict"):
        return tuple((k, plain(v)) for k, v in value.asDict().items())
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def oracle_rows(sql: str, folder: Path):
    con = duckdb.connect()
    for table in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    return sorted(columns), rows_of(columns, result.fetchall())


def query_rows(df):
    return sorted(df.columns), rows_of(df.columns, df.collect())


def same(df, sql: str, folder: Path):
    columns, rows = query_rows(df)
    want_columns, want = oracle_rows(sql, folder)
    assert columns == want_columns
    assert len(rows) == len(want)
    for got, expected in zip(rows, want):
        assert got == expected
