"""Compares a query's rows with DuckDB's for its SQL."""

from __future__ import annotations

import glob
import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if glob.glob(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, dict):
        return tuple(plain(v) for v in x.values())
    if isinstance(x, list | tuple):
        return tuple(plain(v) for v in x)
    return x


def rows(names, data) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def assert_same(df, con, sql: str) -> int:
    got_names, got = df.columns, [tuple(r) for r in df.collect()]
    rel = con.sql(sql)
    assert sorted(got_names) == sorted(rel.columns)
    a, b = rows(got_names, got), rows(rel.columns, rel.fetchall())
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
    return len(got)
