"""Runs a query's SQL in DuckDB and compares rows, whatever their order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(str(tuple(_plain(r[i]) for i in order)) for r in found)


def check(con, df, sql):
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())
