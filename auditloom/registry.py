"""Queries and their SQL, collected by name as modules are imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Maps query names to Spark callables and, where SQL can say the same, to DuckDB SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return keep


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables, by the readers of Spark."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
