"""Rows of a Spark query against rows of SQL in DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(r[n]) for n in names) for r in df.collect())


def sql_rows(con, sql):
    found = con.execute(sql)
    cols = [d[0] for d in found.description]
    at = [cols.index(n) for n in sorted(cols)]
    return sorted(cols), sorted(tuple(plain(r[k]) for k in at) for r in found.fetchall())
