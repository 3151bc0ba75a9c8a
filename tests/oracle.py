"""Compares a query with its SQL on DuckDB."""

from __future__ import annotations

import os

import duckdb


def views(directory: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for file in os.listdir(directory):
        path = os.path.join(directory, file)
        db.execute(f"create view {file.split('.')[0]} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 6))
    return repr(list(value) if isinstance(value, (list, tuple)) else value)


def rows(df) -> tuple[list[str], list[tuple]]:
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())


def expected(db: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    result = db.execute(sql)
    names = [x[0] for x in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())
