"""The register of queries: a name, how Spark answers it, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries {key}")
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return add


def r6(name: str, alias: str | None = None) -> Column:
    """A double rounded to six digits, as both engines can agree on it; -0 becomes 0."""
    return (F.round(F.col(name), 6) + F.lit(0.0)).alias(alias or name)
