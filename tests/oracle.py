"""Comparison of a query's rows with DuckDB's."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def same_rows(df, con, sql):
    q = con.sql(sql)
    names = sorted(q.columns)
    assert sorted(df.columns) == names
    theirs = [tuple(plain(dict(zip(q.columns, r, strict=True))[n]) for n in names) for r in q.fetchall()]
    ours = [tuple(plain(r[n]) for n in names) for r in df.collect()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(ours, key=key) == sorted(theirs, key=key)
