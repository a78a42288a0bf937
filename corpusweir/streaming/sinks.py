"""Micro-batch handlers: incremental vectorisation, feedback, alerts, index upkeep."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEVERITIES = ("info", "warning", "error", "critical")


def alerts(path: str, at_least: str = "error") -> Callable[[DataFrame, int], None]:
    """Handler writing the events of a batch from a severity upwards, one folder per batch."""
    wanted = SEVERITIES[SEVERITIES.index(at_least):]

    def handle(batch: DataFrame, batch_id: int) -> None:
        # Overwriting the batch's own folder makes a repeated batch harmless.
        batch.filter(F.col("severity").isin(*wanted)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return handle


def feedback(path: str) -> Callable[[DataFrame, int], None]:
    """Handler keeping path performance records for the weight adjustment."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return handle


def pending(docs: DataFrame, vectorised: DataFrame | None, limit: int = 50, key: str = "doc_id") -> DataFrame:
    """Next documents without vectors, oldest key first."""
    left = docs if vectorised is None else docs.join(vectorised.select(key), key, "left_anti")
    return left.orderBy(key).limit(limit)


def vectorise(path: str, embed: Callable[[DataFrame], DataFrame], key: str = "doc_id") -> Callable[[DataFrame, int], None]:
    """Handler embedding the documents of a batch that have no vector yet."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        done = _read(batch.sparkSession, path, batch_id)
        fresh = batch if done is None else batch.join(done.select(key), key, "left_anti")
        embed(fresh).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return handle


def _read(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """Vectors of the earlier batches."""
    if batch_id == 0:
        return None
    return spark.read.parquet(path).filter(F.col("batch") < batch_id)


def progress_listener(spark: SparkSession, on_progress: Callable[[dict], None]):
    """Report rows, rate and duration of every micro-batch to ``on_progress``."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event):
            on_progress({"event": "started", "id": str(event.id)})

        def onQueryProgress(self, event):
            p = event.progress
            on_progress({"event": "progress", "batch": p.batchId, "rows": p.numInputRows,
                         "rate": p.processedRowsPerSecond, "millis": p.batchDuration})

        def onQueryIdle(self, event):
            on_progress({"event": "idle", "id": str(event.id)})

        def onQueryTerminated(self, event):
            on_progress({"event": "terminated", "id": str(event.id), "error": event.exception})

    listener = Listener()
    spark.streams.addListener(listener)
    return listener
