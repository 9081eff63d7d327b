"""Registration of runnable queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from zocalo.plans.marketplace import Marketplace
from zocalo.queries.views import with_views

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Runner
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(market) -> DataFrame`` with the SQL that must agree with it."""

    def register(fn: Callable[[Marketplace], DataFrame]):
        def run(spark: SparkSession, path: str) -> DataFrame:
            return fn(Marketplace(spark, path))

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(run, with_views(sql) if sql else None)
        return fn

    return register
