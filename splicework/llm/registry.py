"""The corpus queries, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class CorpusQuery:
    name: str
    run: Run
    sql: str | None


CORPUS: dict[str, CorpusQuery] = {}


def corpus_query(name: str, sql: str | None = None):
    def keep(run: Run) -> Run:
        if name in CORPUS:
            raise ValueError(f"query {name} is registered twice")
        CORPUS[name] = CorpusQuery(name, run, sql)
        return run

    return keep
