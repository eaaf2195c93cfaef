"""Registry of queries and of the SQL that states what they must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attesta.bindings import Tables, with_views

Query = Callable[[Tables], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn

    return keep


def runner(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: fn(Tables(spark, folder))
