"""Message streams and how a bounded run of one is collected."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweir.session import shared_folder

# Progress message (fixed field names).
MESSAGE = "document_id string, status string, progress int, message string, timestamp timestamp"
TERMINAL = ("completed", "failed", "error", "chat_ready")
# Progress of each processing step.
STEP_PROGRESS = {"uploaded": 10, "saved": 20, "processing": 30, "extracted": 50, "vectorizing": 65, "completed": 100}
LATENESS = "10 minutes"


def files(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", fmt: str = "parquet",
          files_per_trigger: int | None = None) -> DataFrame:
    """New files of a folder as a stream; the trigger size bounds a micro-batch."""
    reader = spark.readStream.schema(schema).format(fmt).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Progress messages of a Kafka topic (the connector package must be on the classpath)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return parse_messages(raw.load().select(F.col("value").cast("string").alias("value")))


def parse_messages(raw: DataFrame, column: str = "value") -> DataFrame:
    return raw.select(F.from_json(column, MESSAGE).alias("m")).select("m.*")


def to_messages(progress: DataFrame) -> DataFrame:
    """Progress rows as JSON values, keyed by channel."""
    return progress.select(
        F.concat(F.lit("document_progress_"), F.col("document_id")).alias("key"),
        F.to_json(F.struct("document_id", "status", "progress", "message", "timestamp")).alias("value"),
    )


def publish(progress: DataFrame, path: str, checkpoint: str):
    """Write progress messages as JSON lines; exactly once through the checkpoint."""
    return to_messages(progress).writeStream.format("json").option("path", path).option(
        "checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process what is there, into Parquet in the shared folder, and read it back."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4()}"
    started = stream.writeStream.format("parquet").option("path", f"{base}/out").option(
        "checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_batches(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> None:
    """Process what is there through ``handler(batch, batch_id)``."""
    base = checkpoint or f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4()}/state"
    started = stream.writeStream.foreachBatch(handler).option("checkpointLocation", base).trigger(availableNow=True).start()
    started.awaitTermination()
