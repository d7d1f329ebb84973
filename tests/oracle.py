"""Comparison of a query with its SQL over the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):
        return int(v) if v == int(v) else round(v, 9)
    return v.item() if hasattr(v, "item") else v


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(_plain(v) for v in r) for r in df.itertuples(index=False)), key=repr)


def tables() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def same(spark, query, sql: str) -> None:
    got, expected = query(spark, SF).toPandas(), tables().execute(sql).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)
