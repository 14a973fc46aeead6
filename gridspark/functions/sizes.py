"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a few numbers each: some megabytes at most.
ROWS = 100_000


def small(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has ``rows`` rows at most (one short job finds out), else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
