"""Dealing rows out to all cores before work that is heavy for each row."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Tasks for each core.
WAVES = 2


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df over all cores by its keys, however few splits its files have: a small file may hold many rows, each of which becomes a large text."""
    return df.repartition(WAVES * df.sparkSession.sparkContext.defaultParallelism, *keys)
