"""Rows of a Spark query and of its DuckDB SQL in one comparable form."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def connection(folder):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return f"{v:.7g}"
    return str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(plain(v) for v in r) for r in frame.itertuples(index=False, name=None))
