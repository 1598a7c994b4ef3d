"""Name, Spark form and checking SQL of every query."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None = None


class Registry:
    """Collects queries as modules define them."""

    def __init__(self) -> None:
        self.entries: dict[str, Query] = {}

    def query(self, sql: str | None = None) -> Callable[[Run], Run]:
        def add(run: Run) -> Run:
            self.entries[run.__name__] = Query(run, sql)
            return run

        return add


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """The same rows with the named doubles rounded for comparison."""
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])
