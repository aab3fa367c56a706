"""Runs a registered query and its SQL over the same tables and compares rows whatever their order."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def _cell(v) -> str:
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    cols = sorted(df.columns)
    return sorted(zip(*[[_cell(v) for v in df[c].tolist()] for c in cols], strict=True))


def assert_same(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    a, b = spark_df.toPandas(), con.sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert len(a) == len(b)
    assert rows(a) == rows(b)
