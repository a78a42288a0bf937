"""Retrieval in stages that stops, per query, once the result is good enough."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweir.config import PATHS, RetrievalConfig
from corpusweir.functions.text import let
from corpusweir.operators import analysis
from corpusweir.plans.retrieval import Corpus, fused_candidates, limited, ranked_lists, with_text
from corpusweir.session import checkpointed


@dataclass(frozen=True)
class Stage:
    name: str
    number: int
    top_k: int
    max_docs: int
    budget_seconds: float
    threshold: float
    paths: tuple[str, ...]


# The stage table.
STAGES = (
    Stage("fast", 0, 5, 10, 10.0, 0.6, ("vector", "keywords")),
    Stage("standard", 1, 10, 20, 15.0, 0.4, ("vector", "keywords", "summary")),
    Stage("deep", 2, 15, 40, 25.0, 0.2, PATHS),
    Stage("exhaustive", 3, 25, 80, 40.0, 0.0, PATHS),
)
EXCELLENT = 0.8
SCORE_SHARES = {"fusion_score": 0.4, "similarity_score": 0.3, "bm25_score": 0.2, "rerank_score": 0.1}
RELEVANCE_SHARE, DIVERSITY_SHARE = 0.7, 0.3


def with_stage(name: str, stages: tuple[Stage, ...] = STAGES, **changes) -> tuple[Stage, ...]:
    """The stage table with one stage changed."""
    return tuple(replace(s, **changes) if s.name == name else s for s in stages)


def start_stage(complexity: Column, confidence: Column) -> Column:
    """Complex or uncertain queries skip the first stage."""
    return F.when((complexity == "complex") | (confidence < 0.5), 1).otherwise(0)


def result_quality(rows: DataFrame, analysed: DataFrame) -> DataFrame:
    """(query_id, quality) of ranked rows (query_id, rank, content, scores).

    Lists are top-k bounded, so a query's contents may be gathered for the
    coverage of its entities and keywords.
    """
    score = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in SCORE_SHARES.items() if c in rows.columns),
                F.lit(0.0))
    agg = rows.groupBy("query_id").agg(
        (F.sum(score / F.col("rank")) / F.sum(1.0 / F.col("rank"))).alias("relevance"),
        F.count("*").alias("n"), F.avg(F.length("content")).alias("_mean"),
        F.stddev_pop(F.length("content")).alias("_sd"), F.collect_list(F.lower("content")).alias("_texts"),
    )
    joined = agg.join(analysed.select("query_id", "entities", "keywords"), "query_id")

    def covered(terms: Column) -> Column:
        found = F.size(F.filter(terms, lambda t: F.exists("_texts", lambda x: F.contains(x, F.lower(t)))))
        return F.when(F.size(terms) == 0, 0.0).otherwise(found / F.nullif(F.size(terms), F.lit(0)))

    diversity = (
        F.when(F.col("n") <= 1, 1.0).when(F.col("_mean") == 0, 0.0)
        .otherwise(F.least(F.col("_sd") / F.nullif(F.col("_mean"), F.lit(0.0)), F.lit(1.0)))
    )
    coverage = let(F.col("entities"), covered) + let(F.col("keywords"), covered)
    quality = (
        F.col("relevance") * RELEVANCE_SHARE + diversity * DIVERSITY_SHARE * 0.5
        + coverage / 2 * DIVERSITY_SHARE * 0.5
    )
    return joined.select("query_id", F.least(quality, F.lit(1.0)).alias("quality"))


def retrieve_progressive(corpus: Corpus, queries: DataFrame, config: RetrievalConfig = RetrievalConfig(),
                         top: int = 20, max_stage: str = "deep", stages: tuple[Stage, ...] = STAGES) -> DataFrame:
    """Best stage result per query.

    Every stage runs for the queries that are still open, as one plan; a query
    leaves once its quality reaches the stage's threshold.  Stage results are
    checkpointed, so no stage is computed again by the next one.
    """
    analysed = checkpointed(analysis.analyse(queries).withColumn(
        "_start", start_stage(F.col("complexity"), F.col("confidence"))))
    weighted = analysis.as_rows(analysis.blended_weights(analysed, config.weights()), "a_")
    last = next(s.number for s in stages if s.name == max_stage)
    closed: DataFrame | None = None
    results: DataFrame | None = None
    for stage in (s for s in stages if s.number <= last):
        todo = analysed.filter(F.col("_start") <= stage.number)
        if closed is not None:
            todo = todo.join(closed, "query_id", "left_anti")
        if todo.limit(1).count() == 0:
            continue
        asked = queries.join(todo.select("query_id"), "query_id", "left_semi")
        part = limited(config, stage.paths, stage.top_k)
        shares = weighted.filter(F.col("path").isin(*stage.paths))
        lists = ranked_lists(corpus, asked, part)
        fused = fused_candidates(lists, part, shares, stage.max_docs)
        rows = with_text(fused.filter(F.col("rank") <= stage.max_docs), corpus)
        found = checkpointed(rows.join(result_quality(rows, analysed), "query_id").withColumn(
            "stage", F.lit(stage.name)).withColumn("stage_number", F.lit(stage.number)))
        results = found if results is None else results.unionByName(found)
        good = found.filter(F.col("quality") >= min(stage.threshold, EXCELLENT)).select("query_id").distinct()
        closed = good if closed is None else closed.unionByName(good)
    if results is None:
        raise ValueError("no query to answer")
    best = results.groupBy("query_id").agg(
        F.max(F.struct("quality", (-F.col("stage_number")).alias("later"))).alias("_b"), F.max("stage_number").alias("stage_reached"))
    picked = best.select("query_id", F.col("_b.quality").alias("quality"), "stage_reached",
                         (-F.col("_b.later")).alias("stage_number"))
    return results.drop("quality").join(picked, ["query_id", "stage_number"]).filter(F.col("rank") <= top)
