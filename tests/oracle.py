"""Rows of a query and of its DuckDB counterpart, made comparable."""

import glob
import os

import duckdb
import pandas as pd


def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        name, src = os.path.basename(f)[:-8], f + "/*.parquet" if os.path.isdir(f) else f
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{src}'")
    return con


def _norm(v):
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(_norm(x) for x in v)
    return v


def rows(frame, cols):
    return sorted((tuple(_norm(v) for v in r) for r in frame[cols].itertuples(index=False)), key=repr)


def assert_same(spark_df, sql, sf_dir):
    got, want = spark_df.toPandas(), duck(sf_dir).sql(sql).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = rows(got, cols), rows(want, cols)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for p, q in zip(x, y, strict=True):
            assert p == q or (isinstance(p, (int, float)) and isinstance(q, (int, float)) and abs(p - q) <= 1e-9 * max(1, abs(p))), (cols, x, y)
