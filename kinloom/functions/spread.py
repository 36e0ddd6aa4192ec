"""Rows dealt over more tasks than their table has parts."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a task.
ROWS = 20_000


def spread(df: DataFrame, *keys: str, of: DataFrame | None = None, rows: int = ROWS) -> DataFrame:
    """df dealt by keys, some `rows` rows a task; for what makes much of each row, or takes long over it.

    Spark cuts files, and joins parts of a shuffle, by bytes: a packed table of short rows would be few tasks, however much comes of it.
    The rows of df are counted first, or those of a frame with about as many that is cheaper to count.
    """
    n = -(-(df if of is None else of).count() // rows)
    return df.repartition(n, *keys) if n > 1 else df
