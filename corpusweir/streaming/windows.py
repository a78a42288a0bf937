"""Rolling metrics as windowed aggregates.

The event-time policy is this library's own: rows later than ten minutes behind
the newest event are dropped and a window is emitted once it is that old.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweir.streaming.source import LATENESS


def metric_windows(stream: DataFrame, ts: str, keys: list[str], value: str, length: str = "1 hour",
                   slide: str | None = None, lateness: str = LATENESS) -> DataFrame:
    """Count, mean, min and max per window and key; partial aggregates meet in the state."""
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    return (
        stream.withWatermark(ts, lateness).groupBy(window.alias("w"), *keys)
        .agg(F.count("*").alias("n"), F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "avg", "min", "max")
    )
