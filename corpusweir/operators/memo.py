"""Memoised results as a table instead of a process cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(requests: DataFrame, memo: DataFrame, now: Column, ttl: int | None = None) -> DataFrame:
    """Requests with the stored ``result`` and whether it was a hit.

    ``memo(cache_key, result, stored_at)``; entries older than ``ttl`` seconds count as absent.
    """
    valid = memo
    if ttl is not None:
        age = now.cast("timestamp").cast("double") - F.col("stored_at").cast("timestamp").cast("double")
        valid = memo.filter(age <= ttl)
    return requests.join(valid.select("cache_key", "result"), "cache_key", "left").withColumn(
        "hit", F.col("result").isNotNull()
    )


def store(memo: DataFrame, new: DataFrame, capacity: int = 1000) -> DataFrame:
    """Memo after storing ``new``: latest entry per key, the ``capacity`` newest keys."""
    both = memo.unionByName(new)
    latest = both.groupBy("cache_key").agg(
        F.max_by("result", "stored_at").alias("result"), F.max("stored_at").alias("stored_at")
    )
    return latest.orderBy(F.desc("stored_at"), F.asc("cache_key")).limit(capacity)


def remove(memo: DataFrame, keys: DataFrame) -> DataFrame:
    return memo.join(keys.select("cache_key"), "cache_key", "left_anti")
