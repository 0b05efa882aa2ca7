"""Runs a query in Spark and its SQL in DuckDB and compares all rows."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows_of(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


def check(spark, sf: str, build, sql: str) -> int:
    found = build(spark, sf)
    got = rows_of(found.columns, [tuple(r) for r in found.collect()])
    wanted = duck(sf).sql(sql)
    assert sorted(wanted.columns) == sorted(found.columns)
    expected = rows_of(wanted.columns, wanted.fetchall())
    assert got == expected
    return len(got)
