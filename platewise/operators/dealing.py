"""Rows dealt by a key to as many tasks as there are rows for, so that what one task holds does not grow with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that one task is dealt.
ROWS = 1 << 18


def tasks_for(rows: DataFrame, per: int = ROWS) -> int:
    """How many tasks of ``per`` rows ``rows`` is for, which are counted: hand in a table whose count is cheap. Few rows go to all cores."""
    n = rows.count()
    return max(n // per + 1, min(rows.sparkSession.sparkContext.defaultParallelism, n // 4096 + 1))


def dealt(rows: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """``rows`` in ``tasks`` partitions by ``keys``. Aggregates and windows by these and further columns need no other shuffle.

    Left to itself, Spark combines what it has shuffled to few tasks by its compressed size, and a task's state grows with the table.
    """
    return rows.repartition(tasks, *keys)
