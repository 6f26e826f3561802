"""Order-free comparison of Spark and DuckDB results."""

import decimal
import os

import duckdb
import numpy as np
import pandas as pd


def plain(x):
    if x is None or x is pd.NA or (isinstance(x, float) and x != x):
        return "NULL"
    if isinstance(x, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(plain, x)) + "]"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (float, np.floating, decimal.Decimal)):
        v = round(float(x), 6) + 0.0
        return str(int(v)) if v == int(v) else repr(v)
    return str(x)


def normal(df):
    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


def database(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        path = f"{sf_dir}/{f}"
        con.execute(f"create view {f.split('.')[0]} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def same(spark_df, con, sql):
    a, b = spark_df.toPandas(), con.execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    x, y = normal(a), normal(b)
    assert len(x) == len(y)
    assert x == y, [p for p in zip(x, y, strict=True) if p[0] != p[1]][:3]
