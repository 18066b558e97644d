"""Compares a query with its oracle SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(v) -> str:
    if v is None or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(canonical, v)) + "]"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    if isinstance(v, (float, np.floating)):
        return repr(float(v))
    return str(v)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return c


def canonical_rows(columns: list[str], rows: list) -> list[str]:
    order = [columns.index(c) for c in sorted(columns)]
    return sorted("|".join(canonical(r[i]) for i in order) for r in rows)


def assert_same(df, sql: str, connection: duckdb.DuckDBPyConnection) -> None:
    found = connection.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    assert canonical_rows(df.columns, df.collect()) == canonical_rows(found.columns, found.fetchall())
