"""Runs a query and its SQL over the same tables and compares the rows."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    connection = duckdb.connect()
    connection.execute("SET threads = 4")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return value if math.isnan(value) else float(f"{value:.12g}")
    return value


def spark_rows(df):
    names = sorted(df.columns)
    rows = [tuple(_plain(row[n]) for n in names) for row in df.collect()]
    return names, sorted(rows, key=repr)


def sql_rows(connection, sql):
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_plain(row[i]) for i in order) for row in result.fetchall()]
    return [columns[i] for i in order], sorted(rows, key=repr)


def difference(df, connection, sql):
    """None when both sides agree, else a short account of how they differ."""
    left_names, left = spark_rows(df)
    right_names, right = sql_rows(connection, sql)
    if left_names != right_names:
        return f"columns {left_names} != {right_names}"
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)} rows"
    for a, b in zip(left, right):
        if a != b:
            return f"{str(a)[:400]} != {str(b)[:400]}"
    return None
