"""Comparison of a query with its SQL on the small tables."""

import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir=SF):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    cell = lambda x: "NULL" if pd.isna(x) else repr(float(x)) if isinstance(x, float) else str(x).replace(" 00:00:00", "")
    return list(frame.columns), sorted(str([cell(x) for x in r]) for r in frame.itertuples(index=False))


def assert_same(spark, query, sql, sf_dir=SF):
    got, want = rows(query(spark, sf_dir).toPandas()), rows(connect(sf_dir).execute(sql).df())
    assert got == want
