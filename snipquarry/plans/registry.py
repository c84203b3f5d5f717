"""Registered queries over the engine's own operators, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..engine import tables
from ..operators.catalog import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (Tables) under its name; without SQL only rows are checked."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(tables(spark, folder))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add
