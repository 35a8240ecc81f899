"""Holds a query's rows against those of its SQL."""

from __future__ import annotations

import math

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return x


def check(spark, query, sql):
    got = query(spark, SF)
    cols = sorted(got.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in got.collect())
    want = database().execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())
