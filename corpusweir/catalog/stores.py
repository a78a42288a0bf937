"""Versioned tables: migration, revision and deletion with everything that belongs to a document."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusweir.catalog.registry import query, table, texts
from corpusweir.operators import chunking
from corpusweir.session import shared_folder
from corpusweir.sources.versioned import Store, delete_documents, migrate_into

TABLES = {
    "documents": ("doc_id bigint, text string, lang string, source string, n_chars bigint", "doc_id"),
    "chunks": ("parent_id string, doc_id bigint, content string", "doc_id"),
    "messages": ("conv_id bigint, turn int, role string, text string", "conv_id"),
}
MARK = " (second revision)"


def _chunks(docs):
    return chunking.fixed_parents(docs.select("doc_id", "text")).select("parent_id", "doc_id", "content")


def _store(spark, sf) -> Store:
    """Four commits: migration, the messages once more, revisions, deletions."""
    docs = texts(spark, sf).withColumn("n_chars", F.col("n_chars").cast("long"))
    messages = table(spark, sf, "conversations").withColumn("turn", F.col("turn").cast("int"))
    labels = table(spark, sf, "labels")
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4()}", TABLES, buckets=16)
    migrate_into(store, {"documents": docs, "chunks": _chunks(docs), "messages": messages}, ("chunks", "messages"))
    migrate_into(store, {"messages": messages.filter("role = 'user'")}, ("messages",))
    revised = docs.join(labels.filter("quality = 1").select("doc_id"), "doc_id", "left_semi").withColumn("text", F.concat("text", F.lit(MARK)))

    def revise(change):
        change.upsert("documents", revised)
        change.delete("chunks", revised)
        change.append("chunks", _chunks(revised))

    store.commit(revise, "revision")
    delete_documents(store, labels.filter("toxic = 1").select("doc_id"))
    return store


@query("store_documents", f"""WITH d AS (SELECT doc_id, CASE WHEN quality = 1 THEN text || '{MARK}' ELSE text END AS text
  FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS DISTINCT FROM 1)
 SELECT doc_id, md5(text) AS text_md5, ceil(length(text) / 1024.0)::BIGINT AS n_chunks FROM d""")
def store_documents(spark, sf):
    """What the last version holds: every document's text with the number of its chunks."""
    store = _store(spark, sf)
    chunks = store.read("chunks").groupBy("doc_id").agg(F.count("*").alias("n"))
    return store.read("documents").join(chunks, "doc_id", "left").select(
        "doc_id", F.md5("text").alias("text_md5"), F.coalesce("n", F.lit(0)).cast("long").alias("n_chunks"))


@query("store_versions", """WITH v AS (SELECT unnest([1, 2, 3, 4]) AS version)
 SELECT version, (SELECT count(*) FROM documents LEFT JOIN labels USING (doc_id) WHERE version < 4 OR toxic IS DISTINCT FROM 1) AS documents,
  (SELECT count(*) FROM conversations) + (SELECT count(*) FROM conversations WHERE role = 'user' AND version > 1) AS messages FROM v""")
def store_versions(spark, sf):
    """Rows of every version: older ones stay as they were."""
    store, out = _store(spark, sf), None
    for number in store.log.numbers():
        docs = store.read("documents", number).agg(F.count("*").alias("documents"))
        row = docs.crossJoin(store.read("messages", number).agg(F.count("*").alias("messages"))).select(F.lit(number).alias("version"), "documents", "messages")
        out = row if out is None else out.unionByName(row)
    return out
