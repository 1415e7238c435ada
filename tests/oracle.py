"""Side-by-side comparison of a Spark query and its SQL oracle."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{files}')")
    return con


def _sorted(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype.kind == "f":
            frame[c] = frame[c].round(6) + 0.0
        frame[c] = frame[c].map(lambda v: "null" if v is None or v is np.nan or v != v else str(v))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def assert_same(spark, query, sql: str, sf_dir: str) -> None:
    got = query(spark, sf_dir).toPandas()
    want = connect(sf_dir).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    a, b = _sorted(got), _sorted(want)
    for c in a.columns:
        assert (a[c] == b[c]).all(), (c, a[a[c] != b[c]].head(), b[a[c] != b[c]].head())
