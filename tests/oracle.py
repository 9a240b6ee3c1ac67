"""Rows of a query and of its SQL, in a form that can be compared."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return v if v is None else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def same(df, con, sql):
    o = con.sql(sql)
    assert sorted(df.columns) == sorted(o.columns)
    got, want = rows_of(df.columns, df.collect()), rows_of(o.columns, o.fetchall())
    assert len(got) == len(want)
    assert got == want
    return got
