"""Spark result against oracle SQL, as the driver compares them: columns by name, rows in any order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return str(v)
    return tuple(plain(x) for x in v) if isinstance(v, list | tuple) else v


def rows(names: list[str], found: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    made = [tuple(plain(r[i]) for i in order) for r in found]
    return sorted(made, key=lambda r: tuple((x is None, str(x)) for x in r))


def agrees(df, con, sql: str) -> None:
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())
