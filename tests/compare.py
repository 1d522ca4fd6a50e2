"""Run a registered query and its SQL twin and compare the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _norm(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def rows_of_spark(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    rows = [tuple(_norm(r[c]) for c in names) for r in df.select(*names).toLocalIterator()]
    return names, sorted(rows, key=repr)


def rows_of_sql(con, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_norm(r[i]) for i in order) for r in cursor.fetchall()]
    return [columns[i] for i in order], sorted(rows, key=repr)


def difference(spark_side, sql_side) -> str | None:
    (a_names, a), (b_names, b) = spark_side, sql_side
    if a_names != b_names:
        return f"columns {a_names} != {b_names}"
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first: {str(bad[0][0])[:600]} | {str(bad[0][1])[:600]}"
    kinds = [(n, type(x), type(y)) for n, x, y in zip(a_names, a[0], b[0], strict=True) if type(x) is not type(y)] if a else []
    return f"types {kinds}" if kinds else None
