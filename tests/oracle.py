"""Running a query and its DuckDB SQL on the same tables, and comparing the rows."""

import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(d: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        p = f"{d}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if v != v else float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "asDict"):
        return tuple(map(plain, v))
    return v


def same(df, relation) -> None:
    names = sorted(df.columns)
    assert sorted(relation.columns) == names
    order = lambda r: tuple((v is None, str(v)) for v in r)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=order)
    at = [relation.columns.index(c) for c in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=order)
    assert got == want
