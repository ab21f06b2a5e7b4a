"""Comparing a query with its SQL, run by DuckDB on the same tables."""

import glob
import math
import os
from collections import Counter

import duckdb


def connect(sf: str):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def _norm(x):
    if isinstance(x, float):
        return f"NaN {id(x)}" if math.isnan(x) else repr(x)  # a NaN equals nothing: queries must tell it apart themselves
    return repr(x)


def assert_same(df, con, sql: str):
    rel = con.sql(sql)
    assert sorted(rel.columns) == sorted(df.columns)
    cols = sorted(df.columns)
    at = [rel.columns.index(c) for c in cols]
    a = Counter(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    b = Counter(tuple(_norm(r[k]) for k in at) for r in rel.fetchall())
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
