"""Compares a query with its SQL in DuckDB, values by type, rows in any order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in values)


def same(spark_df, con, sql) -> None:
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(spark_df.columns) == sorted(names)
    assert rows(spark_df.columns, [tuple(r) for r in spark_df.collect()]) == rows(names, cursor.fetchall())
