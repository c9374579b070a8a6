"""Runs a query on Spark and its SQL on DuckDB and compares the rows without regard to order."""

import math
import os
from collections import Counter

import duckdb

DATA = os.environ.get("ASSIZE_TESTDATA", "/root/testdata/sf0.001")


def connect():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in sorted(os.listdir(DATA)):
        if name.endswith(".parquet"):
            con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


def check(spark, con, query, sql):
    df = query(spark, DATA)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    made = con.sql(sql)
    assert sorted(made.columns) == columns
    at = [made.columns.index(c) for c in columns]
    want = Counter(tuple(plain(r[i]) for i in at) for r in made.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
