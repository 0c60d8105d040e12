"""Rows dealt over as many tasks as there is work for, so that what a task holds doesn't grow with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that a task is given, about.
ROWS = 250_000


def tasks(rows: DataFrame, each: int = ROWS) -> int:
    """How many tasks the rows need, and no fewer than the session asks for. Counts them, which of a table is read from the ends of its files."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // each))


def dealt(rows: DataFrame, *keys: str, each: int = ROWS) -> DataFrame:
    """Rows in partitions by keys, each key's rows in one of them, as many as `tasks` says."""
    return rows.repartition(tasks(rows, each), *keys)
