"""Compare a Spark result with DuckDB's answer to the same question."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = Path(folder) / f"{table}.parquet"
        if path.exists():
            con.execute(f"create view {table} as select * from '{path}'")
    return con


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return x


def _sorted_rows(rows, order):
    return sorted(
        (tuple(_value(r[i]) for i in order) for r in rows),
        key=lambda row: tuple((x is not None, type(x).__name__, x) if x is not None else (False, "", "") for x in row),
    )


def spark_rows(df):
    order = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    return [df.columns[i] for i in order], _sorted_rows(df.collect(), order)


def oracle_rows(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], _sorted_rows(cursor.fetchall(), order)
