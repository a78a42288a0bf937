"""Listings, consistency checks, set operations and table rewrites.

``conversations`` stands for the chat tables (``conv_id`` = session, ``turn`` =
position); ``documents`` and ``embeddings`` for the document and vector stores;
``labels`` for the list of valid documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusweir.catalog import sql as S
from corpusweir.catalog.fixtures import chunk_corpus
from corpusweir.catalog.registry import query, table
from corpusweir.functions.text import language, text_hash, words
from corpusweir.operators import chunking, relational as rel
from corpusweir.operators.topk import top_k


def sessions(spark, sf):
    conv = table(spark, sf, "conversations")
    return conv.groupBy(F.col("conv_id").alias("session_id")).agg(
        F.min_by("text", "turn").alias("title"), F.max("turn").alias("updated_at"), F.lit(True).alias("is_active")
    )


def messages(spark, sf, role="assistant"):
    conv = table(spark, sf, "conversations").filter(F.col("role") == role)
    return conv.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("position"), "text")


_SESSIONS = """WITH s AS (SELECT conv_id AS session_id, min_by(text, turn) AS title, max(turn) AS updated_at
  FROM conversations GROUP BY conv_id),
 m AS (SELECT conv_id AS session_id, count(*) AS n FROM conversations WHERE role = 'system' GROUP BY conv_id)"""


@query("session_listing", _SESSIONS + """
 SELECT session_id, md5(title) AS title, updated_at, coalesce(n, 0) AS message_count,
  CASE WHEN coalesce(n, 0) > 0 THEN 'active' ELSE 'empty' END AS status FROM s LEFT JOIN m USING (session_id)""")
def session_listing(spark, sf):
    out = rel.session_listing(sessions(spark, sf), messages(spark, sf, "system"), include_empty=True)
    return out.select("session_id", F.md5("title").alias("title"), "updated_at", "message_count", "status")


@query("session_page", _SESSIONS + """,
 l AS (SELECT session_id, updated_at, n AS message_count FROM s JOIN m USING (session_id))
 SELECT *, (SELECT count(*) FROM l) AS total, 2 AS page, ceil((SELECT count(*) FROM l) / 5.0)::BIGINT AS pages
 FROM l ORDER BY updated_at DESC, session_id LIMIT 5 OFFSET 5""")
def session_page(spark, sf):
    listed = rel.session_listing(sessions(spark, sf), messages(spark, sf, "system")).select(
        "session_id", "updated_at", "message_count"
    )
    return rel.page(listed, [F.desc("updated_at"), F.asc("session_id")], 5, 5)


@query("session_total", _SESSIONS + "SELECT count(*) AS total FROM s JOIN m USING (session_id) WHERE n > 0")
def session_total(spark, sf):
    listed = rel.session_listing(sessions(spark, sf), messages(spark, sf, "system"))
    return listed.agg(F.count("*").alias("total"))


@query("chat_history", """SELECT conv_id AS session_id, turn AS position, md5(text) AS text,
 row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS row FROM conversations WHERE role = 'assistant'
 QUALIFY row <= 2""")
def chat_history(spark, sf):
    out = rel.history(messages(spark, sf), 2)
    return out.select("session_id", "position", F.md5("text").alias("text"), "row")


@query("messages_in_order", """SELECT conv_id, turn, role, md5(text) AS text_md5,
 row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq FROM conversations""")
def messages_in_order(spark, sf):
    # A conversation may be of any length, so its order comes from the scaled numbering.
    from corpusweir.operators.ordering import positions

    conv = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))
    out = positions(conv, ["conv_id"], [F.asc("turn")], "seq")
    return out.withColumn("seq", (F.col("seq") - 1).cast("long"))


@query("search_history_latest", """SELECT event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events
 WHERE event_type = 'view' ORDER BY ts DESC, event_id LIMIT 20""")
def search_history_latest(spark, sf):
    ev = rel.where(table(spark, sf, "events"), {"event_type": "view", "user_id": None})
    out = ev.orderBy(F.desc("ts"), F.asc("event_id")).limit(20)
    return out.select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("document_page", """SELECT doc_id, lang, n_chars, (SELECT count(*) FROM documents) AS total, 3 AS page,
 ceil((SELECT count(*) FROM documents) / 10.0)::BIGINT AS pages
 FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10 OFFSET 20""")
def document_page(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return rel.page(docs, [F.desc("n_chars"), F.asc("doc_id")], 10, 20)


@query("order_page", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice,
 (SELECT count(*) FROM orders) AS total, 1 AS page, ceil((SELECT count(*) FROM orders) / 25.0)::BIGINT AS pages
 FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25""")
def order_page(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    out = rel.page(orders, [F.desc("o_orderdate"), F.asc("o_orderkey")], 25)
    return out.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_totalprice",
                      "total", "page", "pages")


@query("non_empty_content", """SELECT doc_id, n_chars FROM documents WHERE text IS NOT NULL AND text <> ''
 ORDER BY doc_id DESC LIMIT 1000""")
def non_empty_content(spark, sf):
    docs = rel.non_empty(table(spark, sf, "documents"), "text")
    return docs.orderBy(F.desc("doc_id")).limit(1000).select("doc_id", "n_chars")


@query("documents_by_status", "SELECT doc_id, source, lang FROM documents WHERE lang = 'en' AND source = 'src3'")
def documents_by_status(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    return rel.where(docs, {"lang": "en", "source": "src3"})


@query("documents_by_ids", """SELECT doc_id, source, n_chars FROM documents
 WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def documents_by_ids(spark, sf):
    ids = table(spark, sf, "labels").filter("quality = 1")
    return rel.by_ids(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), ids, "doc_id")


@query("chunks_page", "WITH " + S.CHUNKS + """
 SELECT doc_id, parent_id, parent_index, length(content) AS n, len(list_filter(string_split(replace(keywords, ' ', ','), ','), lambda x: trim(x) <> '')) AS keyword_count,
  row_number() OVER (PARTITION BY doc_id ORDER BY parent_index) AS row FROM parent QUALIFY row BETWEEN 3 AND 4""")
def chunks_page(spark, sf):
    parents = chunk_corpus(spark, sf).parents
    listed = parents.select(
        "doc_id", "parent_id", "parent_index", F.length("content").cast("long").alias("n"),
        F.size(rel.keyword_list(F.regexp_replace("keywords", " ", ","))).cast("long").alias("keyword_count"),
    )
    return rel.page_per_group(listed, ["doc_id"], [F.asc("parent_index")], 2, 2)


@query("reshape_events", """SELECT event_id, event_type AS type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
 strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at FROM events""")
def reshape_events(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("event_id", F.col("event_type").alias("type"),
                     F.from_json("props", "k long").getField("k").alias("k"),
                     F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))


@query("flatten_metadata", f"""SELECT doc_id, lang, source, len({S.words('text')}) AS words_count,
 len(string_split(text, chr(10))) AS lines_count FROM documents""")
def flatten_metadata(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", *rel.flatten_metadata(
        {"lang": F.col("lang"), "source": F.col("source")},
        {"words": words(F.col("text")), "lines": F.split("text", "\n")},
    ))


@query("metadata_contains", f"""SELECT doc_id FROM documents
 WHERE list_contains({S.words('text')}, 'der') OR list_contains([lang, source], 'der') OR contains(text, 'der')""")
def metadata_contains(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", "text", words(F.col("text")).alias("keywords"), F.array("lang", "source").alias("entities")
    )
    return rel.metadata_contains(docs, "der", ["keywords", "entities"], "text").select("doc_id")


@query("top_keywords", f"""WITH w AS (SELECT doc_id, unnest({S.words('text')}) AS word,
  generate_subscripts({S.words('text')}, 1) AS pos FROM documents),
 k AS (SELECT doc_id, word, min(pos) AS pos FROM w GROUP BY ALL)
 SELECT doc_id, word, length(word) AS score, row_number() OVER (PARTITION BY doc_id
  ORDER BY length(word) DESC, pos) AS rank FROM k QUALIFY rank <= 5""")
def top_keywords(spark, sf):
    # Every different word of the text with a score, zipped, sorted and cut inside the row.
    docs = table(spark, sf, "documents").select("doc_id", F.array_distinct(words(F.col("text"))).alias("kw"))
    from corpusweir.operators.keywords import top_scored

    scored = docs.withColumn("sc", F.transform("kw", lambda w: F.length(w).cast("double")))
    best = scored.select("doc_id", F.posexplode(top_scored(F.col("kw"), F.col("sc"), 5)).alias("i", "k"))
    return best.select("doc_id", F.col("k.keyword").alias("word"), F.col("k.score").cast("long").alias("score"),
                       (F.col("i") + 1).cast("long").alias("rank"))


# ------------------------------------------------------------ consistency


@query("orphan_vectors", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def orphan_vectors(spark, sf):
    vecs = table(spark, sf, "embeddings").select("vec_id", F.col("vec_id").alias("document_id"))
    valid = table(spark, sf, "labels").select(F.col("doc_id").alias("document_id"))
    return rel.orphans(vecs, valid).select("vec_id")


@query("orphan_vectors_named", """SELECT vec_id, document_id FROM
 (SELECT vec_id, CASE WHEN label = 0 THEN NULL ELSE vec_id END AS document_id FROM embeddings)
 WHERE document_id IS NOT NULL AND document_id NOT IN (SELECT doc_id FROM labels)""")
def orphan_vectors_named(spark, sf):
    vecs = table(spark, sf, "embeddings").select(
        "vec_id", F.when(F.col("label") != 0, F.col("vec_id")).alias("document_id")
    )
    valid = table(spark, sf, "labels").select(F.col("doc_id").alias("document_id"))
    return rel.orphans(vecs, valid, null_is_orphan=False).select("vec_id", "document_id")


@query("orphan_stats", """SELECT sum(n)::BIGINT AS total_chunks, coalesce(sum(n) FILTER (ok IS NULL), 0)::BIGINT
  AS orphaned_chunks, count(*) FILTER (ok IS NULL) AS orphaned_documents, count(*) FILTER (ok) AS valid_documents
 FROM (SELECT vec_id AS document_id, count(*) AS n FROM embeddings GROUP BY 1)
 LEFT JOIN (SELECT DISTINCT doc_id AS document_id, true AS ok FROM labels) USING (document_id)""")
def orphan_stats(spark, sf):
    vecs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("document_id"))
    valid = table(spark, sf, "labels").select(F.col("doc_id").alias("document_id"))
    return rel.orphan_stats(vecs, valid)


@query("orphan_cleanup", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)")
def orphan_cleanup(spark, sf):
    vecs = table(spark, sf, "embeddings").select("vec_id", F.col("vec_id").alias("document_id"), "label")
    valid = table(spark, sf, "labels").select(F.col("doc_id").alias("document_id"))
    return rel.remove_orphans(vecs, valid, dry_run=False).select("vec_id", F.col("label").cast("int").alias("label"))


@query("id_difference", "SELECT doc_id FROM documents EXCEPT SELECT vec_id FROM embeddings")
def id_difference(spark, sf):
    vecs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return table(spark, sf, "documents").select("doc_id").subtract(vecs)


@query("ordered_distinct", f"""SELECT item_id, array_to_string(list_transform(list_sort(list_transform(
   list_distinct(w), lambda x: {{'p': list_position(w, x), 'w': x}}))[1:5], lambda s: s.w), ' ') AS first_five
 FROM (SELECT item_id, {S.words('text')} AS w FROM benchmark)""")
def ordered_distinct(spark, sf):
    bench = table(spark, sf, "benchmark")
    return bench.select("item_id", F.array_join(
        F.slice(F.array_distinct(words(F.col("text"))), 1, 5), " ").alias("first_five"))


@query("adjacent_chunk_similarity", "WITH " + S.CHUNKS + f""",
 w AS (SELECT doc_id, parent_index, list_distinct({S.words('lower(content)')}) AS w FROM parent)
 SELECT a.doc_id, a.parent_index, round(CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0 ELSE
  len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))::DOUBLE END, 6) AS similarity
 FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.parent_index = a.parent_index + 1""")
def adjacent_chunk_similarity(spark, sf):
    parents = chunk_corpus(spark, sf).bare_parents.withColumn("w", words(F.lower("content")))
    pairs = rel.adjacent_pairs(parents, "doc_id", "parent_index", "w")
    return pairs.select("doc_id", "parent_index", F.round(rel.jaccard(
        F.col("current"), F.col("following")), 6).alias("similarity"))


@query("text_hashes", "SELECT doc_id, md5(text) AS hash FROM documents")
def text_hashes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text_hash(F.col("text")).alias("hash"))


# ----------------------------------------------------------------- aggregates


@query("processing_stats", """SELECT CASE WHEN GROUPING(lang) = 0 THEN 'lang' WHEN GROUPING(source) = 0 THEN 'source'
  ELSE 'total' END AS dimension, coalesce(lang, source, '') AS value, count(*) AS n, sum(n_chars)::BIGINT AS total_size
 FROM documents GROUP BY GROUPING SETS ((lang), (source), ())""")
def processing_stats(spark, sf):
    return rel.processing_stats(table(spark, sf, "documents"), ["lang", "source"], "n_chars")


@query("order_stats", """SELECT CASE WHEN GROUPING(o_orderstatus) = 0 THEN 'o_orderstatus'
  WHEN GROUPING(o_orderpriority) = 0 THEN 'o_orderpriority' ELSE 'total' END AS dimension,
  coalesce(o_orderstatus, o_orderpriority, '') AS value, count(*) AS n, sum(o_custkey)::BIGINT AS total_size
 FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""")
def order_stats(spark, sf):
    return rel.processing_stats(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], "o_custkey")


@query("customer_order_listing", """SELECT c_custkey AS session_id, c_name AS title, coalesce(n, 0) AS message_count,
  CASE WHEN coalesce(n, 0) > 0 THEN 'active' ELSE 'empty' END AS status
 FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def customer_order_listing(spark, sf):
    cust = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("session_id"), F.col("c_name").alias("title"), F.lit(True).alias("is_active"))
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("session_id"))
    return rel.session_listing(cust, orders, include_empty=True).drop("is_active")


@query("chunk_statistics", "WITH " + S.CHUNKS + """
 SELECT p AS parent_chunks_count, c AS child_chunks_count, round(ap, 2) AS avg_parent_chunk_size,
  round(ac, 2) AS avg_child_chunk_size, round(c / p::DOUBLE, 2) AS avg_children_per_parent FROM
 (SELECT count(*) AS p, avg(length(content)) AS ap FROM parent), (SELECT count(*) AS c, avg(length(content)) AS ac FROM child)""")
def chunk_statistics(spark, sf):
    corpus = chunk_corpus(spark, sf)
    return chunking.chunk_statistics(corpus.bare_parents, corpus.bare_children)


@query("chunk_languages", "WITH " + S.CHUNKS + f"""
 SELECT lang, count(*) AS n FROM (SELECT CASE WHEN length({S.strip('content')}) = 0 THEN 'unknown'
   WHEN len(regexp_extract_all(content, '[\\x{{4e00}}-\\x{{9fff}}]')) / length({S.strip('content')})::DOUBLE > 0.7 THEN 'zh'
   WHEN len(regexp_extract_all(content, '[\\x{{4e00}}-\\x{{9fff}}]')) / length({S.strip('content')})::DOUBLE < 0.1 THEN 'en'
   ELSE 'mixed' END AS lang FROM parent) GROUP BY lang""")
def chunk_languages(spark, sf):
    parents = chunk_corpus(spark, sf).bare_parents.select(language(F.col("content")).alias("lang"))
    return parents.groupBy("lang").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------------- rewrites


@query("upsert_documents", """SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
 UNION ALL SELECT doc_id, 'label-' || quality, toxic FROM labels""")
def upsert_documents(spark, sf):
    base = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    changes = table(spark, sf, "labels").select(
        "doc_id", F.concat(F.lit("label-"), F.col("quality").cast("string")).alias("source"),
        F.col("toxic").cast("long").alias("n_chars"))
    return rel.upsert(base, changes, "doc_id")


@query("latest_event_per_user", """SELECT user_id, max_by(event_type, event_id) AS event_type,
 max_by(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id""")
def latest_event_per_user(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    return rel.latest_versions(ev, "user_id", "event_id")


@query("patch_documents", """SELECT d.doc_id, coalesce(CASE WHEN quality = 1 THEN 'good' END, source) AS source, lang,
  CASE WHEN l.doc_id IS NOT NULL THEN 1 ELSE 0 END AS version FROM documents d LEFT JOIN labels l USING (doc_id)""")
def patch_documents(spark, sf):
    base = table(spark, sf, "documents").select("doc_id", "source", "lang", F.lit(0).alias("version"))
    changes = table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "good").alias("source"), F.lit("xx").alias("lang"))
    return rel.patch(base, changes, "doc_id", ["source"], touch="version", now=F.lit(1))


@query("delete_documents", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_documents(spark, sf):
    ids = table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    return rel.hard_delete(table(spark, sf, "documents").select("doc_id", "lang"), ids, "doc_id")


@query("soft_delete_sessions", """SELECT conv_id AS session_id, NOT bool_or(role = 'system') AS is_active
 FROM conversations GROUP BY conv_id""")
def soft_delete_sessions(spark, sf):
    out = rel.soft_delete(sessions(spark, sf), messages(spark, sf, "system"), "session_id")
    return out.select("session_id", "is_active")


@query("cascade_delete_chunks", "WITH " + S.CHUNKS + """, bad AS (SELECT doc_id FROM labels WHERE toxic = 1)
 SELECT 'children' AS tbl, count(*) AS n FROM child WHERE doc_id NOT IN (FROM bad)
 UNION ALL SELECT 'parents', count(*) FROM parent WHERE doc_id NOT IN (FROM bad)
 UNION ALL SELECT 'vectors', count(*) FROM embeddings WHERE vec_id NOT IN (FROM bad)""")
def cascade_delete_chunks(spark, sf):
    parents = chunking.fixed_parents(table(spark, sf, "documents"))
    left = rel.cascade_delete(
        table(spark, sf, "labels").filter("toxic = 1").select("doc_id"),
        {"parents": parents, "children": chunking.fixed_children(parents),
         "vectors": table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))}, "doc_id")
    parts = [df.agg(F.count("*").alias("n")).withColumn("tbl", F.lit(t)) for t, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("vector_ids", "WITH " + S.CHUNKS + """
 SELECT CASE WHEN child_index = 0 THEN chunk_id ELSE doc_id || '_chunk_' || child_index END AS id, count(*) AS n
 FROM child GROUP BY 1""")
def vector_ids(spark, sf):
    parents = chunking.fixed_parents(table(spark, sf, "documents").select("doc_id", "text"))
    kids = chunking.fixed_children(parents).select(
        F.when(F.col("child_index") == 0, F.col("chunk_id")).otherwise("").alias("chunk_id"),
        F.col("doc_id").cast("string").alias("document_id"), F.col("child_index").alias("chunk_index"))
    return rel.vector_rows(kids).groupBy("id").agg(F.count("*").alias("n"))


@query("merge_vector_metadata", """SELECT doc_id, lang AS language, source, 'updated' AS summary FROM documents""")
def merge_vector_metadata(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.create_map(
        F.lit("language"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("summary"), F.lit("old")
    ).alias("metadata"))
    out = rel.merge_metadata(docs, "metadata", {"summary": F.lit("updated")})
    return out.select("doc_id", F.col("metadata")["language"].alias("language"),
                      F.col("metadata")["source"].alias("source"), F.col("metadata")["summary"].alias("summary"))


@query("backfill_times", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') END
 AS vectorization_time FROM orders""")
def backfill_times(spark, sf):
    from corpusweir.sources.tables import backfill_vectorization_time

    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "completed").otherwise("pending").alias("status"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"), F.lit(None).cast("string").alias("vectorization_time"))
    return backfill_vectorization_time(orders, "status").select("o_orderkey", "vectorization_time")


@query("newest_documents_per_source", """SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC)
 AS row FROM documents QUALIFY row <= 3""")
def newest_documents_per_source(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id")
    return top_k(docs, ["source"], [F.desc("doc_id")], 3, "row")
