"""Queries by name, each with SQL for an independent engine where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arborlens.plans.analogue import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame. sql may name the views of plans.analogue; it starts with SELECT,
    or with a comma and further common table expressions."""

    def register(f):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(key)
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = SQL + sql
        return f

    return register
