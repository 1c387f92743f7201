"""Compare a query with its SQL on the same tables."""

from __future__ import annotations

import glob
import os

import duckdb


def normal(rows) -> list[tuple[str, ...]]:
    return sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in row) for row in rows)


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{source}'")
    return con


def assert_same(df, con, sql: str) -> None:
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({sql}) AS wanted").fetchall()
    assert normal(df.select(columns).collect()) == normal(want)
