"""Tables that are broadcast, and rows that are dealt to tasks: only with a size that has been looked at."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that rows are dealt to at most: up to so many, a task writes its rows straight to their files and sorts nothing before.
PARTS = 200


def fits(df: DataFrame, most: int) -> bool:
    """Whether a table has so many rows at most; reads no more than one row beyond."""
    return df.limit(most + 1).count() <= most


def bounded(df: DataFrame, most: int, what: str) -> DataFrame:
    """The table, to be broadcast; an error if it is larger than what it is meant for."""
    if not fits(df, most):
        raise ValueError(f"more than {most} {what}")
    return F.broadcast(df)


def dealt(df: DataFrame, key: str, rows: int, each: int) -> DataFrame:
    """The table in parts by key, about `each` of `rows` to a part; a fixed number, as parts are joined to a few large ones otherwise."""
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(min(PARTS, max(least, math.ceil(rows / each))), key)
