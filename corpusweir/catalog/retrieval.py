"""Retrieval, fusion and re-ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusweir.catalog import sql as S
from corpusweir.catalog.fixtures import (
    chunk_corpus, chunk_lists, chunk_queries, doc_fields, doc_lists, doc_text_hits, doc_vectors, query_set, query_vectors,
)
from corpusweir.catalog.registry import query, table
from corpusweir.config import DEFAULT_WEIGHTS, RetrievalConfig, preset
from corpusweir.functions.text import words
from corpusweir.operators import bm25, context, fusion, normalise, parents, rerank
from corpusweir.operators.vector import most_similar, vector_topk
from corpusweir.plans import retrieval as plan
from corpusweir.session import checkpointed, is_few


def r6(name: str, out: str | None = None):
    return F.round(F.col(name), 6).alias(out or name)


# ---------------------------------------------------------------- BM25


@query("bm25_content_topk", "WITH " + S.DOC_FIELDS + "," + S.bm25("20") + """
 SELECT query_id, rank, doc_id, round(score, 6) AS score FROM rk WHERE field = 'content'""")
def bm25_content_topk(spark, sf):
    rows = doc_fields(spark, sf, ("content",))
    found = bm25.search_fields(rows, query_set(spark, sf), 20)
    return found.select("query_id", "rank", "doc_id", r6("score"))


@query("bm25_multi_field", "WITH " + S.DOC_FIELDS + "," + S.bm25(S.PATH_LIMITS) + """
 SELECT query_id, field, rank, doc_id, round(score, 6) AS score FROM rk""")
def bm25_multi_field(spark, sf):
    return doc_text_hits(spark, sf).select("query_id", "field", "rank", "doc_id", r6("score"))


@query("bm25_first_field_wins", "WITH " + S.DOC_FIELDS + "," + S.bm25(S.PATH_LIMITS) + """,
 pr AS (SELECT *, CASE field WHEN 'keywords' THEN 1 WHEN 'summary' THEN 2 ELSE 3 END AS p FROM rk),
 fw AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY p) = 1),
 fk AS (SELECT query_id, doc_id, field, score,
   row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p, doc_id) AS rank FROM fw)
 SELECT query_id, rank, doc_id, field, round(score, 6) AS score FROM fk WHERE rank <= 10""")
def bm25_first_field_wins(spark, sf):
    best = bm25.first_field_wins(doc_text_hits(spark, sf), k=10)
    return best.select("query_id", "rank", "doc_id", "field", r6("score"))


@query("bm25_field_scores", "WITH " + S.DOC_FIELDS + "," + S.bm25() + """
 SELECT field, query_id, count(*) AS n_scored, round(max(score), 6) AS best, round(avg(score), 6) AS mean
 FROM sc GROUP BY ALL""")
def bm25_field_scores(spark, sf):
    scores = bm25.all_scores(doc_fields(spark, sf), query_set(spark, sf))
    return scores.groupBy("field", "query_id").agg(
        F.count("*").alias("n_scored"), F.round(F.max("score"), 6).alias("best"),
        F.round(F.avg("score"), 6).alias("mean"),
    )


@query("bm25_keywords_only", "WITH " + S.DOC_FIELDS + "," + S.bm25("5") + """
 SELECT query_id, rank, doc_id, round(score, 6) AS score FROM rk WHERE field = 'keywords'""")
def bm25_keywords_only(spark, sf):
    rows = doc_fields(spark, sf, ("keywords",))
    found = bm25.search_fields(rows, query_set(spark, sf), 5)
    return found.select("query_id", "rank", "doc_id", r6("score"))


@query("bm25_corpus_stats", "WITH " + S.DOC_FIELDS + "," + S.bm25() + """
 SELECT field, n_docs, round(avgdl, 6) AS avgdl, round(mean_idf, 6) AS mean_idf
 FROM st JOIN mi USING (field)""")
def bm25_corpus_stats(spark, sf):
    stats = bm25.corpus_stats(bm25.tokenised(doc_fields(spark, sf))).fields
    return stats.select("field", "n_docs", r6("avgdl"), r6("mean_idf"))


# -------------------------------------------------------------- vectors


@query("vector_topk", "WITH " + S.VECTOR + """
 SELECT query_id, rank, doc_id, round(score, 6) AS score FROM vk WHERE rank <= 10""")
def vector_top10(spark, sf):
    found = vector_topk(doc_vectors(spark, sf), query_vectors(spark, sf), 10)
    return found.select("query_id", "rank", "doc_id", r6("score"))


@query("vector_topk_filtered", "WITH " + S.VECTOR + """
 SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vs.doc_id) AS rank,
  vs.doc_id, round(score, 6) AS score
 FROM vs JOIN embeddings ON vec_id = vs.doc_id WHERE label = 1 AND score >= 0.1 QUALIFY rank <= 10""")
def vector_topk_filtered(spark, sf):
    labelled = doc_vectors(spark, sf).filter("label = 1")
    found = vector_topk(labelled, query_vectors(spark, sf), 10, min_score=0.1)
    return found.select("query_id", "rank", "doc_id", r6("score"))


@query("most_similar_vector", "WITH " + S.VECTOR + """
 SELECT query_id, doc_id, round(greatest(score, 0), 6) AS score FROM (
  SELECT b.item_id AS query_id, coalesce(vk.doc_id, -1) AS doc_id, coalesce(score, 0) AS score
  FROM benchmark b LEFT JOIN vk ON b.item_id = vk.query_id AND rank = 1)""")
def most_similar_vector(spark, sf):
    best = most_similar(doc_vectors(spark, sf), query_vectors(spark, sf))
    return best.select("query_id", "doc_id", r6("score"))


# --------------------------------------------------- normalisation


#: Length of the retrieved lists that are normalised.
LISTED = 50


def _content_scores(spark, sf):
    """The list that the content path retrieves, as fusion normalises it."""
    rows = doc_fields(spark, sf, ("content",))
    found = bm25.search_fields(rows, query_set(spark, sf), LISTED)
    return checkpointed(found.select("query_id", "doc_id", "score"))


_SC = "WITH " + S.DOC_FIELDS + "," + S.bm25("50") + ", s AS (SELECT query_id, doc_id, score FROM rk WHERE field = 'content')"


@query("norm_minmax", _SC + """
 SELECT query_id, doc_id, round(CASE WHEN count(*) OVER w = 1 THEN score
  WHEN max(score) OVER w = min(score) OVER w THEN 1.0
  ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS norm
 FROM s WINDOW w AS (PARTITION BY query_id)""")
def norm_minmax(spark, sf):
    return normalise.min_max(_content_scores(spark, sf), ["query_id"]).select("query_id", "doc_id", r6("norm"))


@query("norm_zscore", _SC + """
 SELECT query_id, doc_id, round(CASE WHEN count(*) OVER w = 1 THEN score
  WHEN stddev_pop(score) OVER w = 0 THEN 0.0
  ELSE (score - avg(score) OVER w) / stddev_pop(score) OVER w END, 6) AS norm
 FROM s WINDOW w AS (PARTITION BY query_id)""")
def norm_zscore(spark, sf):
    return normalise.z_score(_content_scores(spark, sf), ["query_id"]).select("query_id", "doc_id", r6("norm"))


@query("norm_rank", _SC + """
 SELECT query_id, doc_id, round(1.0 - (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1)
  / (count(*) OVER (PARTITION BY query_id))::DOUBLE, 6) AS norm FROM s""")
def norm_rank(spark, sf):
    return normalise.by_rank(_content_scores(spark, sf), ["query_id"], "doc_id").select(
        "query_id", "doc_id", r6("norm")
    )


# ------------------------------------------------------------- fusion

_LISTS = "WITH " + S.DOC_LISTS


@query("fuse_weighted_rrf", _LISTS + """
 , f AS (SELECT query_id, doc_id, round(sum(weight / (60 + rank)), 9) AS s,
   string_agg(path || ':' || rank || ':' || printf('%.4f', norm), ',' ORDER BY path) AS contributions
   FROM nrm GROUP BY ALL)
 SELECT query_id, doc_id, round(s, 6) AS fusion_score, contributions,
  row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM f QUALIFY rank <= 20""")
def fuse_weighted_rrf(spark, sf):
    fused = fusion.weighted_rrf(doc_lists(spark, sf), DEFAULT_WEIGHTS)
    entries = F.transform(
        F.map_entries("path_contributions"),
        lambda e: F.format_string("%s:%d:%.4f", e["key"], e["value"]["rank"], e["value"]["score"]),
    )
    return fused.select("query_id", "doc_id", r6("fusion_score"), "rank",
                        F.array_join(entries, ",").alias("contributions"))


@query("fuse_simple_rrf", _LISTS + """
 , f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS s FROM lists GROUP BY ALL)
 SELECT query_id, doc_id, round(s, 6) AS fusion_score,
  row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM f QUALIFY rank <= 20""")
def fuse_simple_rrf(spark, sf):
    fused = fusion.fuse("simple_rrf", doc_lists(spark, sf))
    return fused.select("query_id", "doc_id", r6("fusion_score"), "rank")


@query("fuse_weighted_sum", _LISTS + """
 , f AS (SELECT query_id, doc_id, round(sum(weight * norm), 9) AS s FROM nrm GROUP BY ALL)
 SELECT query_id, doc_id, round(s, 6) AS fusion_score,
  row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM f QUALIFY rank <= 20""")
def fuse_weighted_sum(spark, sf):
    fused = fusion.fuse("weighted_sum", doc_lists(spark, sf), DEFAULT_WEIGHTS)
    return fused.select("query_id", "doc_id", r6("fusion_score"), "rank")


@query("fuse_equal_weights", _LISTS + """
 , n AS (SELECT query_id, count(DISTINCT path) AS p FROM lists GROUP BY query_id)
 , f AS (SELECT query_id, doc_id, round(sum(1.0 / p / (60 + rank)), 9) AS s
   FROM lists JOIN n USING (query_id) GROUP BY ALL)
 SELECT query_id, doc_id, round(s, 6) AS fusion_score,
  row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM f QUALIFY rank <= 20""")
def fuse_equal_weights(spark, sf):
    fused = fusion.fuse("weighted_rrf", doc_lists(spark, sf), None)
    return fused.select("query_id", "doc_id", r6("fusion_score"), "rank")


@query("fuse_max_score", _LISTS + """
 , f AS (SELECT query_id, doc_id, greatest(max(score), 0) AS s FROM lists GROUP BY ALL)
 SELECT query_id, doc_id, round(s, 6) AS fusion_score,
  row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM f QUALIFY rank <= 20""")
def fuse_max_score(spark, sf):
    fused = fusion.fuse("max_score", doc_lists(spark, sf))
    return fused.select("query_id", "doc_id", r6("fusion_score"), "rank")


@query("outer_merge_paths", _LISTS + """
 SELECT query_id, doc_id,
  max(CASE WHEN path = 'vector' THEN rank END) AS vector_rank,
  round(max(CASE WHEN path = 'vector' THEN score END), 6) AS vector_score,
  max(CASE WHEN path = 'keywords' THEN rank END) AS keywords_rank,
  round(max(CASE WHEN path = 'keywords' THEN score END), 6) AS keywords_score,
  max(CASE WHEN path = 'summary' THEN rank END) AS summary_rank,
  round(max(CASE WHEN path = 'summary' THEN score END), 6) AS summary_score,
  max(CASE WHEN path = 'content' THEN rank END) AS content_rank,
  round(max(CASE WHEN path = 'content' THEN score END), 6) AS content_score
 FROM lists GROUP BY ALL""")
def outer_merge_paths(spark, sf):
    merged = fusion.outer_merge(doc_lists(spark, sf))
    return merged.select("query_id", "doc_id", *[
        c for p in DEFAULT_WEIGHTS for c in (F.col(f"{p}_rank"), r6(f"{p}_score"))
    ])


@query("diversity_penalty", _LISTS + f"""
 , f AS (SELECT query_id, doc_id, round(sum(weight / (60 + rank)), 9) AS s FROM nrm GROUP BY ALL)
 , t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rk FROM f QUALIFY rk <= 40)
 , d AS (SELECT t.*, list_distinct({S.words('lower(text)')}) AS w FROM t JOIN documents USING (doc_id))
 , p AS (SELECT a.query_id, a.doc_id, a.s, max(CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0 ELSE
     len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))::DOUBLE END) AS sim
   FROM d a LEFT JOIN d b ON a.query_id = b.query_id AND b.rk < a.rk GROUP BY ALL)
 , e AS (SELECT query_id, doc_id, 0.1 * coalesce(sim, 0) AS penalty,
   round(s * (1 - 0.1 * coalesce(sim, 0)), 9) AS fs FROM p)
 SELECT query_id, doc_id, round(fs, 6) AS fusion_score, round(penalty, 6) AS diversity_penalty,
  row_number() OVER (PARTITION BY query_id ORDER BY fs DESC, doc_id) AS rank FROM e QUALIFY rank <= 20""")
def diversity_penalty(spark, sf):
    fused = fusion.weighted_rrf(doc_lists(spark, sf), DEFAULT_WEIGHTS, keep=40)
    texts = fused.join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").withColumn(
        "w", words(F.lower("text"))
    )
    out = fusion.diversity_penalty(texts, F.col("w"), 0.1, 20)
    return out.select("query_id", "doc_id", r6("fusion_score"), r6("diversity_penalty"), "rank")


# ------------------------------------------------ parents

_CHILD = "WITH " + S.CHILD_LISTS


@query("dedup_parents", _CHILD + """
 SELECT query_id, path, rank, doc_id, parent_id, round(score, 6) AS score FROM ddp""")
def dedup_parents(spark, sf):
    kept = parents.dedup_parents(chunk_lists(spark, sf))
    return kept.select("query_id", "path", "rank", "doc_id", "parent_id", r6("score"))


@query("dedup_stats", _CHILD + """
 , b AS (SELECT path, count(*) AS n FROM lists GROUP BY path)
 , a AS (SELECT path, count(*) AS m FROM ddp GROUP BY path)
 , r AS (SELECT path, n, m FROM b JOIN a USING (path) UNION ALL
   SELECT 'total', sum(n), sum(m) FROM b JOIN a USING (path))
 SELECT path, n::BIGINT AS original_count, m::BIGINT AS deduplicated_count, (n - m)::BIGINT AS removed_count,
  round((n - m) / greatest(n, 1)::DOUBLE, 6) AS deduplication_rate FROM r""")
def dedup_stats(spark, sf):
    lists = chunk_lists(spark, sf)
    out = parents.dedup_stats(lists, parents.dedup_parents(lists))
    return out.select(F.coalesce("path", F.lit("total")).alias("path"), "original_count",
                      "deduplicated_count", "removed_count", r6("deduplication_rate"))


@query("parent_distribution", _CHILD + """
 SELECT parent_id, string_agg(path, ',' ORDER BY path) AS paths, count(*) AS path_count,
  sum(n)::BIGINT AS total_small_chunks
 FROM (SELECT parent_id, path, count(*) AS n FROM lists WHERE parent_id IS NOT NULL GROUP BY ALL) GROUP BY parent_id""")
def parent_distribution(spark, sf):
    return parents.parent_distribution(chunk_lists(spark, sf))


@query("path_metrics", _CHILD + """
 SELECT query_id, path, round(avg(score), 6) AS relevance_score,
  round(CASE WHEN count(*) < 2 THEN 1.0 ELSE least(var_pop(length(content)) / (avg(length(content)) + 1), 1.0) END, 6)
   AS diversity_score,
  round(least(count(*) / CASE path WHEN 'vector' THEN 50.0 WHEN 'keywords' THEN 30.0 ELSE 20.0 END, 1.0), 6)
   AS coverage_score
 FROM lists JOIN child ON chunk_id = lists.doc_id GROUP BY query_id, path""")
def path_metrics(spark, sf):
    corpus = chunk_corpus(spark, sf)
    out = plan.path_metrics(chunk_lists(spark, sf, corpus), corpus, RetrievalConfig().top_ks())
    return out.select("query_id", "path", r6("relevance_score"), r6("diversity_score"), r6("coverage_score"))


_FUSED = "WITH " + S.FUSED


@query("small_to_big_switch", _FUSED + """
 SELECT query_id, fusion_rank AS rank, cnd.doc_id AS original_id, parent_id, md5(parent.content) AS content_md5,
  parent.summary AS parent_summary, parent.keywords AS parent_keywords, round(fusion_score, 6) AS fusion_score
 FROM cnd JOIN parent USING (parent_id)""")
def small_to_big_switch(spark, sf):
    corpus = chunk_corpus(spark, sf)
    fused = checkpointed(plan.fused_candidates(chunk_lists(spark, sf, corpus), RetrievalConfig()))
    few = is_few(fused)
    out = parents.switch_to_parents(plan.with_text(fused, corpus, few), corpus.parents, few=few)
    return out.select("query_id", "rank", "original_id", "parent_id", F.md5("content").alias("content_md5"),
                      "parent_summary", "parent_keywords", r6("fusion_score"))


@query("switch_stats", _FUSED + """
 SELECT count(*) AS total_processed, count(p.parent_id) AS parent_chunks_found,
  count(cnd.parent_id) - count(p.parent_id) AS parent_chunks_missing, 0::BIGINT AS small_chunks_kept,
  round(count(p.parent_id) / greatest(count(*), 1)::DOUBLE, 6) AS switch_success_rate
 FROM cnd LEFT JOIN (SELECT parent_id FROM parent WHERE parent_index > 0) p ON p.parent_id = cnd.parent_id""")
def switch_stats(spark, sf):
    # Parents of index 0 are left out so that both outcomes occur.
    corpus = chunk_corpus(spark, sf)
    fused = plan.fused_candidates(chunk_lists(spark, sf, corpus), RetrievalConfig())
    out = parents.switch_stats(fused, corpus.parents.filter("parent_index > 0"))
    return out.select("total_processed", "parent_chunks_found", "parent_chunks_missing", "small_chunks_kept",
                      r6("switch_success_rate"))


# -------------------------------------------------------- rerank (R18-R23) and flagship


@query("rerank_score_fusion", _FUSED + """
 SELECT query_id, rank, doc_id, round(fused_rerank_score, 6) AS fused_rerank_score FROM rrk""")
def rerank_score_fusion(spark, sf):
    out = plan.retrieve(chunk_corpus(spark, sf), chunk_queries(spark, sf))
    return out.select("query_id", "rank", "doc_id", r6("fused_rerank_score"))


@query("rerank_similarity", _FUSED + """
 SELECT query_id, doc_id, round(coalesce(similarity_score, 0), 6) AS similarity_score,
  row_number() OVER (PARTITION BY query_id ORDER BY coalesce(similarity_score, 0) DESC, doc_id) AS rank
 FROM cnd QUALIFY rank <= 20""")
def rerank_similarity(spark, sf):
    fused = plan.fused_candidates(chunk_lists(spark, sf), RetrievalConfig())
    out = rerank.by_similarity(fused.drop("rank"), 20)
    return out.select("query_id", "doc_id", "rank",
                      F.round(F.coalesce("similarity_score", F.lit(0.0)), 6).alias("similarity_score"))


@query("rerank_given_scores", _FUSED + """
 , ms AS (SELECT c.query_id, c.doc_id, length(child.content) / 256.0 AS s
   FROM cnd c JOIN child ON chunk_id = c.doc_id WHERE trim(child.content) <> '')
 SELECT query_id, doc_id, round(s, 6) AS rerank_score,
  row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM ms QUALIFY rank <= 5""")
def rerank_given_scores(spark, sf):
    corpus = chunk_corpus(spark, sf)
    fused = checkpointed(plan.fused_candidates(chunk_lists(spark, sf, corpus), RetrievalConfig()))
    fused = plan.with_text(fused, corpus, is_few(fused))
    scores = fused.select("query_id", "doc_id", (F.length("content") / 256.0).alias("rerank_score"))
    out = rerank.by_scores(fused.drop("rank"), scores, 5)
    return out.select("query_id", "doc_id", r6("rerank_score"), "rank")


@query("rerank_hybrid", _FUSED + """
 , c AS (SELECT cnd.*, child.content, round((0.4 * fusion_score + coalesce(0.3 * bm25_score, 0)
     + coalesce(0.2 * similarity_score, 0)) / (0.4 + CASE WHEN bm25_score IS NOT NULL THEN 0.3 ELSE 0 END
     + CASE WHEN similarity_score IS NOT NULL THEN 0.2 ELSE 0 END), 9) AS f
   FROM cnd JOIN child ON chunk_id = cnd.doc_id)
 , h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, doc_id) AS fr FROM c QUALIFY fr <= 30)
 , n AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM h)
 , l AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id
     ORDER BY length(content) / 256.0 DESC, doc_id) AS rank FROM n WHERE n > 10 AND trim(content) <> '' QUALIFY rank <= 10)
 SELECT query_id, doc_id, rank FROM l UNION ALL SELECT query_id, doc_id, fr FROM n WHERE n <= 10""")
def rerank_hybrid(spark, sf):
    corpus = chunk_corpus(spark, sf)
    fused = checkpointed(plan.fused_candidates(chunk_lists(spark, sf, corpus), RetrievalConfig()))
    fused = plan.with_text(fused, corpus, is_few(fused))
    scores = fused.select("query_id", "doc_id", (F.length("content") / 256.0).alias("rerank_score"))
    out = rerank.rerank("hybrid", fused.drop("rank"), 10, scores)
    return out.select("query_id", "doc_id", "rank")


@query("rerank_cache_keys", _FUSED + """
 SELECT query_id, md5(any_value(b.text) || ':' || string_agg(doc_id, ':' ORDER BY doc_id) || ':score_fusion') AS cache_key
 FROM cnd JOIN benchmark b ON b.item_id = query_id GROUP BY query_id""")
def rerank_cache_keys(spark, sf):
    fused = plan.fused_candidates(chunk_lists(spark, sf), RetrievalConfig())
    ids = fused.groupBy("query_id").agg(F.collect_list("doc_id").alias("ids"))  # at most 40 ids
    return ids.join(query_set(spark, sf), "query_id").select(
        "query_id", rerank.cache_key(F.col("text"), F.col("ids"), F.lit("score_fusion")).alias("cache_key")
    )


@query("retrieve_basic", "WITH " + S.CHILD_FIELDS + "," + S.bm25("20") + "," + S.CHILD_VECTOR + """,
 u AS (SELECT query_id, doc_id, score FROM rk UNION ALL SELECT query_id, doc_id, score FROM vk WHERE rank <= 20),
 b AS (SELECT query_id, doc_id, max(score) AS s FROM u GROUP BY ALL)
 SELECT query_id, doc_id, round(s, 6) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM b QUALIFY rank <= 20""")
def retrieve_basic(spark, sf):
    out = plan.retrieve_basic(chunk_corpus(spark, sf), chunk_queries(spark, sf), 20)
    return out.select("query_id", "doc_id", r6("score"), "rank")


@query("four_path_retrieval", _FUSED + """
 SELECT query_id, rank, rrk.doc_id AS original_id, parent_id, md5(parent.content) AS content_md5,
  round(fusion_score, 6) AS fusion_score, round(fused_rerank_score, 6) AS fused_rerank_score,
  (SELECT string_agg(path || ':' || d.rank, ',' ORDER BY path) FROM ddp d
    WHERE d.query_id = rrk.query_id AND d.doc_id = rrk.doc_id) AS contributions
 FROM rrk JOIN parent USING (parent_id)""")
def four_path_retrieval(spark, sf):
    """Four paths, dedup per parent, weighted RRF, re-ranking, parent switch."""
    corpus = chunk_corpus(spark, sf)
    best = checkpointed(plan.retrieve(corpus, chunk_queries(spark, sf)))
    few = is_few(best)
    out = parents.switch_to_parents(plan.with_text(best, corpus, few), corpus.parents, few=few)
    entries = F.transform(
        F.map_entries("path_contributions"), lambda e: F.format_string("%s:%d", e["key"], e["value"]["rank"])
    )
    return out.select("query_id", "rank", "original_id", "parent_id", F.md5("content").alias("content_md5"),
                      r6("fusion_score"), r6("fused_rerank_score"),
                      F.array_join(entries, ",").alias("contributions"))


@query("context_assembly", _FUSED + """
 , t AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, parent.content,
   split_part(parent_id, '-', 1) AS source, fused_rerank_score AS s FROM rrk JOIN parent USING (parent_id) WHERE rank <= 5)
 SELECT query_id, string_agg(rank || ' (来源: ' || source || ', 相关度: ' || printf('%.3f', s) || '):' || chr(10)
  || content || chr(10), chr(10) ORDER BY rank) AS context,
  round(avg(CASE WHEN rank <= 3 THEN s END), 6) AS confidence_score
 FROM t GROUP BY query_id""")
def context_assembly(spark, sf):
    corpus = chunk_corpus(spark, sf)
    best = checkpointed(plan.retrieve(corpus, chunk_queries(spark, sf)).filter("rank <= 5"))
    few = is_few(best)
    out = parents.switch_to_parents(plan.with_text(best, corpus, few), corpus.parents, few=few)
    rows = out.withColumn("source", F.split_part("parent_id", F.lit("-"), F.lit(1))).withColumn(
        "relevance", F.col("fused_rerank_score")
    )
    return context.assemble(rows).select("query_id", "context", r6("confidence_score"))
