"""Rows of a query and of its SQL in DuckDB, made comparable."""

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())


def sql_rows(con, sql):
    table = con.execute(sql).to_arrow_table() if hasattr(con, "to_arrow_table") else con.execute(sql).arrow()
    table = table.read_all() if hasattr(table, "read_all") else table
    columns = sorted(table.column_names)
    return columns, sorted(tuple(plain(r[c]) for c in columns) for r in table.to_pylist())
