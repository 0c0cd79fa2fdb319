"""Compare a Spark query with its SQL in DuckDB, rows in any order."""

import os

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0
    return x


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


def assert_same(df, sql, sf=SF):
    got = df.collect()
    rel = connect(sf).sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    a, b = rows(df.columns, got), rows(rel.columns, rel.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == y or all(p == q or isinstance(p, float) and abs(p - q) < 2e-6 for p, q in zip(x, y, strict=True)), (x, y)
