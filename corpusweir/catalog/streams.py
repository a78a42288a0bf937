"""Streaming queries: ``events`` arrive as a file stream and are run to the end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusweir.catalog.monitoring import circuit_breaker as _batch  # noqa: F401  (same statement below)
from corpusweir.catalog.registry import ORACLE, query, table
from corpusweir.session import shared_folder
from corpusweir.streaming import sinks, source, stateful, windows


def stream(spark, sf):
    raw = source.files(spark, sf, table(spark, sf, "events").schema, "events.parquet")
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id",
                      F.col("event_type").alias("component"), "value", (F.col("value") > 60).alias("failed"))


@query("stream_metric_windows", """SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type AS component,
  count(*) AS n, round(avg(value) + 1e-9, 6) AS avg, min(value) AS min, max(value) AS max FROM events
 GROUP BY 1, 2, time_bucket(INTERVAL 1 HOUR, ts)
 HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_metric_windows(spark, sf):
    out = source.run_available(windows.metric_windows(stream(spark, sf), "ts", ["component"], "value"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "component", "n",
                      F.round(F.col("avg") + 1e-9, 6).alias("avg"), "min", "max")


@query("stream_circuit_breaker", ORACLE["circuit_breaker"])
def stream_circuit_breaker(spark, sf):
    out = stateful.circuit_breaker(stream(spark, sf), "component", "ts", "event_id", "failed", 2, 3600.0)
    return source.run_available(out)


@query("stream_progress", ORACLE["progress_replay"])
def stream_progress(spark, sf):
    out = source.run_available(stateful.progress_relay(
        stream(spark, sf), "user_id", "ts", "event_id", "component", ("purchase",), 3600, 36000))
    beat, late = F.col("status") == "heartbeat", F.col("status") == "timeout"
    return out.groupBy("user_id").agg(
        F.count_if(~beat & ~late & (F.col("status") != "connected")).alias("relayed"),
        F.count_if(beat).alias("heartbeats"),
        F.coalesce(F.max(F.when(F.col("ended"), F.when(late, "timeout").otherwise("finished"))), F.lit("open")).alias("ended"))


@query("stream_session_expiry", """SELECT user_id, true AS expired FROM events GROUP BY user_id
 HAVING epoch_ms(min(ts)) + 3600000 < epoch_ms((SELECT max(ts) FROM events)) - 600000""")
def stream_session_expiry(spark, sf):
    out = source.run_available(stateful.session_expiry(stream(spark, sf), "user_id", "ts"))
    return out.select("user_id", "expired")


@query("stream_alerts", """SELECT event_id, event_type AS component, CASE WHEN value > 200 THEN 'critical' ELSE 'error' END AS severity
 FROM events WHERE value > 100""")
def stream_alerts(spark, sf):
    path = f"{shared_folder(spark)}/alerts-{uuid.uuid4()}"
    rows = stream(spark, sf).withColumn(
        "severity", F.when(F.col("value") > 200, "critical").when(F.col("value") > 100, "error").otherwise("warning"))
    source.run_batches(rows, sinks.alerts(path))
    return spark.read.parquet(path).select("event_id", "component", "severity")


@query("progress_messages", """SELECT 'document_progress_' || user_id AS key, event_type AS status,
 count(*) AS n FROM events GROUP BY ALL""")
def progress_messages(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("document_id"), F.col("event_type").alias("status"),
        F.lit(50).alias("progress"), F.lit("step").alias("message"), F.col("ts").cast("timestamp").alias("timestamp"))
    sent = source.to_messages(rows)
    back = source.parse_messages(sent)
    keyed = back.select(F.concat(F.lit("document_progress_"), "document_id").alias("key"), "status")
    return keyed.groupBy("key", "status").agg(F.count("*").alias("n"))


@query("pending_vectorisation", """SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
 ORDER BY doc_id LIMIT 50""")
def pending_vectorisation(spark, sf):
    vecs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return sinks.pending(table(spark, sf, "documents").select("doc_id"), vecs, 50)
