"""Runs a registered query and its SQL side by side."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return db


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


def assert_same(df, db: duckdb.DuckDBPyConnection, sql: str) -> None:
    want = db.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    got, right = _rows(df.columns, df.collect()), _rows(want.columns, want.fetchall())
    assert len(got) == len(right)
    assert got == right
