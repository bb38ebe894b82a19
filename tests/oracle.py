"""Comparison of registered queries with their DuckDB SQL."""

import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        path = f"{sf_dir}/{f}"
        con.sql(f"create view {f.split('.')[0]} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def compare(spark, query, sql: str, sf_dir: str = SMALL) -> None:
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    own = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    result = connect(sf_dir).sql(sql)
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    assert own == sorted(repr(tuple(r[i] for i in at)) for r in result.fetchall())
