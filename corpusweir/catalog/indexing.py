"""Stored indexes that are built, changed and searched."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusweir.catalog import sql as S
from corpusweir.catalog.fixtures import doc_vectors, query_set, query_vectors
from corpusweir.catalog.registry import query, table, texts
from corpusweir.operators import bm25
from corpusweir.operators.stored_index import StoredIndex
from corpusweir.operators.vector_index import VectorIndex
from corpusweir.session import shared_folder

#: Searched fields: the source and the whole text.
FIELDS = ("source", "text")
MARK = " reviewed revision"


def _index(spark) -> StoredIndex:
    return StoredIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4()}")


def _rows(docs):
    return bm25.field_rows(docs, {f: f for f in FIELDS})


_ROWS = """WITH rws AS (SELECT doc_id, 'source' AS field, coalesce(source, '') AS text FROM documents
  UNION ALL SELECT doc_id, 'text', coalesce(text, '') FROM documents),"""

_STATS = """, n AS (SELECT field, count(*) AS n_postings, sum(tf)::BIGINT AS n_tokens FROM tf GROUP BY field),
 nt AS (SELECT field, count(*) AS n_terms FROM df GROUP BY field)
 SELECT field, n_docs, round(avgdl, 6) AS avgdl, round(mean_idf, 6) AS mean_idf, n_terms, n_postings, n_tokens
 FROM st JOIN mi USING (field) JOIN n USING (field) JOIN nt USING (field)"""


def _described(index: StoredIndex):
    """What the index holds, by field."""
    version = index.log.latest()
    stats = index.stats(version)
    terms = stats.terms.filter("term <> ''").groupBy("field").agg(F.count("*").alias("n_terms"))
    held = index._live(version.content, "postings", index.posting_schema).groupBy("field").agg(
        F.count("*").alias("n_postings"), F.sum("tf").alias("n_tokens"))
    return stats.fields.join(terms, "field").join(held, "field").select(
        "field", "n_docs", F.round("avgdl", 6).alias("avgdl"), F.round("mean_idf", 6).alias("mean_idf"), "n_terms", "n_postings", "n_tokens")


@query("index_build", _ROWS + S.bm25() + _STATS)
def index_build(spark, sf):
    index = _index(spark)
    index.append(_rows(texts(spark, sf)))
    return _described(index)


# Documents of good quality are replaced by a new revision, toxic ones are deleted.
_GROWN = f"""WITH d AS (SELECT documents.doc_id, source, CASE WHEN quality = 1 THEN coalesce(text, '') || '{MARK}' ELSE text END AS text
  FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS DISTINCT FROM 1),
 rws AS (SELECT doc_id, 'source' AS field, coalesce(source, '') AS text FROM d UNION ALL SELECT doc_id, 'text', coalesce(text, '') FROM d),"""


def _grown(spark, sf) -> StoredIndex:
    """English documents, then the others, then revisions, then deletions: four commits."""
    docs, labels = texts(spark, sf), table(spark, sf, "labels")
    index = _index(spark)
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    index.append(_rows(docs.filter(english)))
    index.append(_rows(docs.filter(~english)))
    good = docs.join(labels.filter("quality = 1").select("doc_id"), "doc_id", "left_semi")
    index.append(_rows(good.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(MARK)))), replace=True)
    index.delete(labels.filter("toxic = 1").select("doc_id"))
    return index


@query("index_append", _GROWN + S.bm25() + _STATS)
def index_append(spark, sf):
    return _described(_grown(spark, sf))


_SEARCHED = _GROWN + S.bm25("20") + " SELECT query_id, field, rank, doc_id, round(score, 6) AS score FROM rk"


@query("index_search", _SEARCHED)
def index_search(spark, sf):
    found = _grown(spark, sf).search(query_set(spark, sf), 20)
    return found.select("query_id", "field", "rank", "doc_id", F.round("score", 6).alias("score"))


@query("index_compacted", _SEARCHED)
def index_compacted(spark, sf):
    index = _grown(spark, sf)
    index.compact()
    index.log.vacuum()
    found = index.search(query_set(spark, sf), 20)
    return found.select("query_id", "field", "rank", "doc_id", F.round("score", 6).alias("score"))


@query("vector_index_exact", "WITH " + S.VECTOR + """
 SELECT query_id, rank, doc_id, round(score, 6) AS score FROM vk WHERE rank <= 10""")
def vector_index_exact(spark, sf):
    index = VectorIndex(spark, f"{shared_folder(spark)}/vectors-{uuid.uuid4()}").build(doc_vectors(spark, sf))
    found = index.search(query_vectors(spark, sf), 10)
    return found.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))
