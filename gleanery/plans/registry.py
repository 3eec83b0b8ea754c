"""One registry for queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleanery.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a table reader under its name."""

    def add(build: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[build.__name__] = lambda spark, sf_dir: build(lambda name: table(spark, sf_dir, name))
        if sql:
            SQL[build.__name__] = sql
        return build

    return add
