"""Holds a query's rows against its SQL in DuckDB."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def _plain(value):
    if value is None or pd.isna(value) is True:
        return "-"
    return f"{value:.6g}" if isinstance(value, float) else str(value)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(map(_plain, r)) for r in frame[names].astype(object).itertuples(index=False))


def same(spark_frame, sql, sf_dir):
    assert rows(spark_frame.toPandas()) == rows(connect(sf_dir).sql(sql).df())
