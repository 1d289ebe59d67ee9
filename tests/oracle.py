"""Rows of a query and of its SQL, ready to compare."""

from __future__ import annotations

import collections

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if getattr(v, "tzinfo", None):
        return v.replace(tzinfo=None)
    return bytes(v) if isinstance(v, bytearray) else v


def compare(df, con, sql: str) -> None:
    cols = sorted(df.columns)
    got = collections.Counter(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = collections.Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall())
    assert got and got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
