"""Skew-safe top-k, shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

def top_k(df: DataFrame, group: Sequence[str | Column], order: Sequence[Column], k: int,
          rank_col: str = "rank") -> DataFrame:
    """First ``k`` rows per group. ``row_number() <= k`` lets Spark put a per-partition group limit
    before the exchange, so a hot group ships at most ``k`` rows per map task."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)
