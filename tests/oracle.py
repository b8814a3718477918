"""Holds a query's rows against DuckDB's on the same files."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return bytes(v) if isinstance(v, bytearray) else v


def same(df, con, sql):
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(_plain(v) for _, v in sorted(zip(names, r))) for r in got.fetchall()), key=repr)
    have = sorted((tuple(_plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    assert have == want
