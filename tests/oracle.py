"""Rows of a query and of its SQL in DuckDB, made comparable."""

import os

import duckdb
import pandas as pd


def connection(folder):
    con = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{folder}/{f}'")
    return con


def comparable(frame):
    def value(v):
        if isinstance(v, float):
            return None if v != v else round(v, 6)
        if pd.isna(v):
            return None
        return v if isinstance(v, bool | int) else str(v)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(frame.columns), sorted((tuple(map(value, row)) for row in frame.itertuples(index=False)), key=repr)


def assert_same(query, sql, spark, folder):
    columns, rows = comparable(query(spark, folder).toPandas())
    want_columns, want = comparable(connection(folder).sql(sql).df())
    assert columns == want_columns
    assert rows == want
