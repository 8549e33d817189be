"""Registry of runnable queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docassay.plans.oracle_inputs import compose

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None, uses: tuple[str, ...] = ()):
    """Register ``fn(spark, folder)``; ``oracle`` is SQL over the CTEs named in ``uses``."""

    def wrap(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = compose(uses, oracle)
        return fn

    return wrap
