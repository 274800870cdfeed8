"""Rows of a query against those of its SQL in an independent engine, on the same tables."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return repr(v + 0.0) if isinstance(v, float) else repr(v)


def rows_of_sql(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    return [x[0] for x in found.description], found.fetchall()


def assert_same(df, sql: str, sf_dir: str) -> None:
    names, expected = rows_of_sql(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    at = [names.index(x) for x in order]
    assert sorted(tuple(plain(r[x]) for x in order) for r in df.collect()) == sorted(tuple(plain(r[k]) for k in at) for r in expected)
