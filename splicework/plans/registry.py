"""The list of registered queries, each with the SQL that gives the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .. import session

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    sql: str | None
    covers: tuple[str, ...]


QUERIES: dict[str, Query] = {}


def query(name: str, *covers: str, sql: str | None = None):
    """Register a query under ``name``; ``covers`` lists the SURVEY operator ids it exercises."""

    def keep(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        @functools.wraps(run)
        def begun(spark: SparkSession, d: str) -> DataFrame:
            session.forget_places(spark)
            return run(spark, d)

        QUERIES[name] = Query(name, begun, sql, covers)
        return run

    return keep
