"""Comparing a query with its SQL twin."""

import os

import duckdb
import pandas as pd


def database(folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        path = f"{folder}/{f}"
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _cell(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list):
        return tuple(map(_cell, v))
    if v is None or pd.isna(v):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(repr(tuple(map(_cell, r))) for r in frame[columns].itertuples(index=False))


def check(spark, folder, query, sql):
    assert rows(query(spark, folder).toPandas()) == rows(database(folder).execute(sql).fetchdf())
