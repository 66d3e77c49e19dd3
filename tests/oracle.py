"""Rows of a Spark and a DuckDB result in one comparable form."""

import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"


def plain(x):
    if x is None or (isinstance(x, float) and x != x):
        return None
    if hasattr(x, "tolist"):
        x = x.tolist()
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


def rows(df):
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


def connection(folder=SF):
    c = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c
