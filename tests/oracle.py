"""Compares a query with its SQL on DuckDB over the same Parquet files."""

from __future__ import annotations

import math
import os
import re

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings authors works sentences place_masters "
    "place_aliases sentence_places eval_items admin_areas deleted_records"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(value):
    """A value as comparable text: floats by 9 digits, timestamps without zone."""
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return re.sub(r"\+00:00$", "", str(value))


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted("␟".join(plain(r[i]) for i in order) for r in data)


def both(spark, query, sql: str, sf_dir: str):
    """((columns, rows) of Spark, the same of DuckDB)."""
    df = query(spark, sf_dir)
    con = connect(sf_dir)
    cursor = con.execute(sql)
    return rows(df.columns, [tuple(r) for r in df.collect()]), rows([d[0] for d in cursor.description], cursor.fetchall())
