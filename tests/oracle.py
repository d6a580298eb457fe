"""Compares a query with its SQL in DuckDB, row by row, columns by name."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sql: str, folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return names, cur.fetchall()


def _key(row):
    return tuple((x is None, str(type(x)) if isinstance(x, (list, dict)) else "", round(x, 4) if isinstance(x, float) else x) for x in row)


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b and type(a) is type(b)


def check(df, sql: str, folder: str) -> None:
    names, want = sql_rows(sql, folder)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = [tuple(r[c] for c in order) for r in df.collect()]
    want = [tuple(r[names.index(c)] for c in order) for r in want]
    assert len(got) == len(want), (len(got), len(want))
    for g, w in zip(sorted(got, key=_key), sorted(want, key=_key)):
        assert all(map(same, g, w)), (order, g, w)
