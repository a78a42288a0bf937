"""Ranked-list building blocks shared by every retrieval path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCORE_DIGITS = 9


def stable_score(score: Column) -> Column:
    """Round away float noise so equal documents tie whatever order was summed."""
    return F.round(score, SCORE_DIGITS)


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows per key with their 1-based rank.

    ``row_number() <= k`` becomes a window group limit: every map task keeps
    only its own first ``k`` rows per key before anything is shuffled.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("long")).filter(F.col(rank) <= k)


def rerank_dense(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank: str = "rank"):
    """Number short lists again after rows were removed (lists are top-k bounded)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("long"))
