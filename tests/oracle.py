"""Comparing a query with its SQL over the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        f = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{f if os.path.isfile(f) else f + '/*.parquet'}'")
    return con


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(map(tuple, frame[names].astype(str).values.tolist()))


def agree(con, df, sql):
    got, want = rows(df.toPandas()), rows(con.execute(sql).df())
    assert got[0] == want[0]
    assert got[1] == want[1], (got[1][:3], want[1][:3])
