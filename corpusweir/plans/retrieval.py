"""Many-query retrieval plans.

Everything is keyed by ``query_id`` and answers a whole batch.  Ranked lists are written once
while a plan is built, and query terms and sizes are looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusweir.config import PathSettings, RetrievalConfig
from corpusweir.operators import bm25, fusion, parents, rerank
from corpusweir.operators.inherited import InheritedSearch
from corpusweir.operators.stored_index import StoredIndex
from corpusweir.operators.topk import stable_score, top_k
from corpusweir.operators.vector import vector_topk
from corpusweir.session import checkpointed, is_few, lookup_join

TEXT_PATHS = ("keywords", "summary", "content")


@dataclass(frozen=True)
class Corpus:
    """``children(doc_id, parent_id, content, summary, keywords)``, ``parents(parent_id,
    content, summary, keywords)``, ``vectors(doc_id, embedding)`` of children.  With an
    ``index`` of the children's fields text paths are searched there; without one the
    children are scanned."""

    children: DataFrame
    parents: DataFrame
    vectors: DataFrame
    index: StoredIndex | InheritedSearch | None = None


def ranked_lists(corpus: Corpus, queries: DataFrame, config: RetrievalConfig,
                 quality_threshold: float = 0.0) -> DataFrame:
    """(query_id, path, rank, doc_id, parent_id, score) of every enabled path.

    ``queries(query_id, text, embedding)``.
    """
    limits = config.top_ks()
    parts = []
    text_limits = {p: limits[p] for p in TEXT_PATHS if p in limits}
    if text_limits:
        if corpus.index:
            found = corpus.index.search(queries, text_limits)
        else:
            found = bm25.search_fields(bm25.field_rows(corpus.children, {p: p for p in text_limits}), queries, text_limits)
        parts.append(found.withColumnRenamed("field", "path").select("query_id", "path", "doc_id", "score", "rank"))
    if "vector" in limits:
        found = vector_topk(corpus.vectors, queries, limits["vector"], min_score=quality_threshold or None)
        parts.append(found.select("query_id", F.lit("vector").alias("path"), "doc_id", "score", "rank"))
    lists = parts[0]
    for part in parts[1:]:
        lists = lists.unionByName(part)
    # k rows per query and path: written once, so that no later step searches again.
    kept = checkpointed(lists)
    return lookup_join(kept, corpus.children.select("doc_id", "parent_id"), "doc_id", "left", is_few(kept))


def fused_candidates(lists: DataFrame, config: RetrievalConfig, weights: DataFrame | None = None,
                     top: int | None = None) -> DataFrame:
    """Dedup by parent, then fuse; ``weights(query_id, path, weight)`` overrides the config."""
    deduped = parents.dedup_parents(lists)
    if weights is not None:
        deduped = deduped.join(weights, ["query_id", "path"])
    top = top or 2 * config.fusion.final_top_k
    kept = (
        F.max(F.when(F.col("path") != "vector", F.col("score"))).alias("bm25_score"),
        F.max(F.when(F.col("path") == "vector", F.col("score"))).alias("similarity_score"),
        F.first("parent_id").alias("parent_id"),
    )
    shares = None if weights is not None else config.weights()
    return fusion.fuse(config.fusion.method, deduped, shares, top, config.fusion.rrf_k, kept)


def fused_under(lists: DataFrame, configs: dict[str, RetrievalConfig], top: int | None = None) -> DataFrame:
    """One search under many configurations: ``preset, query_id, doc_id, rank, fusion_score``.

    ``lists`` are fetched once, as long as the longest list any configuration asks for; each
    configuration is a few rows (path, weight, length, rank constant) that the lists are
    joined with, so the number of scans does not depend on how many there are.
    """
    rows = [
        (name, path, float(s.weight), s.top_k, c.fusion.rrf_k, top or c.fusion.final_top_k)
        for name, c in configs.items() for path, s in c.paths.items() if s.enabled and s.weight > 0
    ]
    settings = F.broadcast(lists.sparkSession.createDataFrame(
        rows, "preset string, path string, weight double, _limit int, _k int, _top int"
    ))
    cut = lists.join(settings, "path").filter(F.col("rank") <= F.col("_limit"))
    of_parent = Window.partitionBy("preset", "query_id", "path", "parent_id").orderBy("rank")
    kept = cut.withColumn("_nth", F.row_number().over(of_parent)).filter("_nth = 1 or parent_id is null")
    dense = kept.withColumn("_rank", F.row_number().over(Window.partitionBy("preset", "query_id", "path").orderBy("rank")))
    fused = dense.groupBy("preset", "query_id", "doc_id").agg(
        stable_score(F.sum(F.col("weight") / (F.col("_k") + F.col("_rank")))).alias("fusion_score"), F.first("_top").alias("_top")
    )
    best = Window.partitionBy("preset", "query_id").orderBy(F.desc("fusion_score"), "doc_id")
    return fused.withColumn("rank", F.row_number().over(best).cast("long")).filter("rank <= _top").drop("_top")


def widest(configs: dict[str, RetrievalConfig]) -> RetrievalConfig:
    """The configuration whose lists hold those of all others."""
    longest: dict[str, int] = {}
    for c in configs.values():
        for path, k in c.top_ks().items():
            longest[path] = max(k, longest.get(path, 0))
    return RetrievalConfig({p: PathSettings(1.0, k) for p, k in longest.items()})


def with_text(rows: DataFrame, corpus: Corpus, few: bool | None = None) -> DataFrame:
    return lookup_join(rows, corpus.children.select("doc_id", "content"), "doc_id", few=few)


def retrieve(corpus: Corpus, queries: DataFrame, config: RetrievalConfig = RetrievalConfig(),
             weights: DataFrame | None = None, model_scores: DataFrame | None = None) -> DataFrame:
    """Four paths, dedup per parent, fusion, re-ranking of the head, final cut."""
    return final_list(ranked_lists(corpus, queries, config), corpus, config, weights, model_scores)


def final_list(lists: DataFrame, corpus: Corpus, config: RetrievalConfig = RetrievalConfig(),
               weights: DataFrame | None = None, model_scores: DataFrame | None = None) -> DataFrame:
    """What becomes of the ranked lists of all paths."""
    fused = fused_candidates(lists, config, weights)
    if config.fusion.diversity_penalty > 0:
        texts = with_text(fused, corpus)
        from corpusweir.functions.text import words

        lowered = texts.withColumn("_w", words(F.lower("content")))
        spread = fusion.diversity_penalty(
            lowered, F.col("_w"), config.fusion.diversity_penalty, 2 * config.fusion.final_top_k
        )
        fused = fused.drop("fusion_score", "rank").join(
            spread.select("query_id", "doc_id", "fusion_score", "rank"), ["query_id", "doc_id"]
        )
    if config.rerank.enabled:
        head = fused.filter(F.col("rank") <= config.rerank.top_k).withColumnRenamed("rank", "fusion_rank")
        if model_scores is not None and config.rerank.strategy in ("model", "hybrid"):
            head = with_text(head, corpus)
        return rerank.rerank(config.rerank.strategy, head, config.fusion.final_top_k, model_scores)
    return fused.filter(F.col("rank") <= config.fusion.final_top_k)


def retrieve_basic(corpus: Corpus, queries: DataFrame, k: int = 20) -> DataFrame:
    """Vector hits followed by the multi-field text hits, cut to ``k`` by score."""
    config = RetrievalConfig()
    lists = ranked_lists(corpus, queries, replace(config, paths={
        p: replace(s, top_k=k) for p, s in config.paths.items()
    }))
    best = lists.groupBy("query_id", "doc_id").agg(
        F.max("score").alias("score"), F.min_by("path", "score").alias("path")
    )
    return top_k(best, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)


def path_metrics(lists: DataFrame, corpus: Corpus, limits: dict[str, int]) -> DataFrame:
    """Relevance, diversity and coverage of every (query, path) list."""
    sized = lookup_join(lists, corpus.children.select("doc_id", F.length("content").alias("_len")), "doc_id")
    limit = F.coalesce(*[F.when(F.col("path") == p, F.lit(k)) for p, k in limits.items()])
    agg = sized.groupBy("query_id", "path").agg(
        F.avg("score").alias("relevance_score"), F.count("*").alias("n"),
        F.var_pop("_len").alias("_var"), F.avg("_len").alias("_avg"),
    )
    return agg.select(
        "query_id", "path", "relevance_score",
        F.when(F.col("n") < 2, F.lit(1.0))
        .otherwise(F.least(F.col("_var") / (F.col("_avg") + 1), F.lit(1.0))).alias("diversity_score"),
        F.least(F.col("n") / limit, F.lit(1.0)).alias("coverage_score"),
    )


def limited(config: RetrievalConfig, paths: tuple[str, ...], top: int) -> RetrievalConfig:
    """The configuration of a stage: its paths, each cut to ``top``."""
    return replace(config, paths={
        p: PathSettings(config.paths[p].weight, top) for p in paths if p in config.paths
    })
