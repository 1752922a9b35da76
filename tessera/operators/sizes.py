"""Sides of a join that are small by measure, not by hope."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def bounded(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df to be broadcast if it has no more than most rows, else df as it is for a shuffled join.

    The rows are computed once: a small table continues as a local relation.
    """
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
