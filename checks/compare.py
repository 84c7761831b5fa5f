"""Compare a query's rows with its SQL statement's, run in process by DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        path = Path(folder) / f"{table}.parquet"
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def _sorted_rows(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def difference(spark_rows, spark_names: list[str], connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs, or None. Values must be equal, floats to the last bit."""
    relation = connection.sql(sql)
    if sorted(relation.columns) != sorted(spark_names):
        return f"columns {sorted(spark_names)} <> {sorted(relation.columns)}"
    ours = _sorted_rows(spark_names, [tuple(r) for r in spark_rows])
    theirs = _sorted_rows(list(relation.columns), relation.fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} rows <> {len(theirs)}"
    unequal = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(unequal)} rows differ, first {unequal[0]}" if unequal else None
