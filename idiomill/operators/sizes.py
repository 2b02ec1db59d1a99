"""Broadcasts whose size is checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL = 100_000
"""Rows up to which a side of a join is broadcast."""


def is_small(df: DataFrame, most: int = SMALL) -> bool:
    return df.limit(most + 1).count() <= most


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df, broadcast if it is small; a larger one is left to the planner."""
    return F.broadcast(df) if is_small(df, most) else df
