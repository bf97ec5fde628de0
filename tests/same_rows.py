"""Comparison of a query with its SQL, blind to the order of rows and columns."""

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(value):
    if value is None or value is pd.NA or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool) or str(type(value)) == "<class 'numpy.bool'>":
        return bool(value)
    try:
        return round(float(value), 6) + 0.0 if not isinstance(value, str) else value
    except (TypeError, ValueError):
        return str(value)


def rows(df):
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)
