"""The registered queries of the library and the DuckDB SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fixtures as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: CTEs of the nearest other vectors by cosine.
NEAREST = ", n AS (SELECT id, CAST(vector AS DOUBLE[]) AS v FROM vectors), s AS (SELECT a.id AS src, b.id AS dst, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS similarity FROM n a JOIN n b ON a.id <> b.id), near AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) AS rank FROM s WHERE similarity > 0.4)"


def query(tables: str = "", sql: str | None = None, recursive: bool = False, ints: str = ""):
    """Registers a query with its SQL over the named tables; columns in ``ints`` are 32-bit in Spark and cast so."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            whole = T.with_tables(tables, sql, recursive)
            casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in ints.split())
            ORACLE_SQL[f.__name__] = f"SELECT * REPLACE ({casts}) FROM ({whole})" if ints else whole
        return f

    return register
