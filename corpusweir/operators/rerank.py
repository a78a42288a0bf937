"""Re-ranking of fused candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusweir.operators.topk import stable_score, top_k

# Share of every score in the combined one.
SCORE_WEIGHTS = {"fusion_score": 0.4, "bm25_score": 0.3, "similarity_score": 0.2, "rerank_score": 0.1}

Scorer = Callable[[pd.Series, pd.Series], pd.Series]


def combined_score(columns: list[str], weights: dict[str, float] | None = None) -> Column:
    """Weighted mean of the scores that are present; 0 when none is."""
    weights = weights or SCORE_WEIGHTS
    num, den = F.lit(0.0), F.lit(0.0)
    for name, weight in weights.items():
        if name in columns:
            have = F.col(name).isNotNull()
            num = num + F.when(have, F.col(name) * weight).otherwise(0.0)
            den = den + F.when(have, F.lit(weight)).otherwise(0.0)
    return F.when(den > 0, num / F.nullif(den, F.lit(0.0))).otherwise(0.0)


def score_fusion(docs: DataFrame, k: int = 20, weights: dict[str, float] | None = None) -> DataFrame:
    scored = docs.withColumn("fused_rerank_score", stable_score(combined_score(docs.columns, weights)))
    return top_k(scored, ["query_id"], [F.desc("fused_rerank_score"), F.asc("doc_id")], k)


def by_similarity(docs: DataFrame, k: int = 20) -> DataFrame:
    order = F.coalesce(F.col("similarity_score"), F.lit(0.0))
    return top_k(docs.withColumn("_s", order), ["query_id"], [F.desc("_s"), F.asc("doc_id")], k).drop("_s")


def by_scores(docs: DataFrame, scores: DataFrame, k: int = 5) -> DataFrame:
    """Given model scores (query_id, doc_id, rerank_score); blank documents drop out."""
    kept = docs.drop("rerank_score").filter(F.length(F.trim(F.coalesce("content", F.lit("")))) > 0)
    joined = kept.join(scores, ["query_id", "doc_id"])
    return top_k(joined, ["query_id"], [F.desc("rerank_score"), F.asc("doc_id")], k)


def by_model(docs: DataFrame, scorer: Scorer, k: int = 5) -> DataFrame:
    """Score (query text, content) in Arrow batches with ``scorer``.

    The batch size is ``spark.sql.execution.arrow.maxRecordsPerBatch``; a remote
    scorer opens its client once per task.
    """
    kept = docs.drop("rerank_score").filter(F.length(F.trim(F.coalesce("content", F.lit("")))) > 0)
    schema = T.StructType([*kept.schema.fields, T.StructField("rerank_score", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(rerank_score=scorer(pdf["query"], pdf["content"]))

    return top_k(kept.mapInPandas(run, schema), ["query_id"], [F.desc("rerank_score"), F.asc("doc_id")], k)


def hybrid(docs: DataFrame, k: int, second_stage: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """Score fusion to 3k candidates; a longer list goes through the second stage."""
    first = score_fusion(docs, 3 * k).withColumnRenamed("rank", "first_rank")
    # Lists hold at most 3k rows, so the count per query is a small window.
    sized = first.withColumn("_n", F.expr("count(*) over (partition by query_id)"))
    long = second_stage(sized.filter(F.col("_n") > k).drop("_n"), k)
    short = sized.filter(F.col("_n") <= k).drop("_n").withColumn("rank", F.col("first_rank"))
    return long.unionByName(short, allowMissingColumns=True)


def rerank(strategy: str, docs: DataFrame, k: int = 20, scores: DataFrame | None = None,
           weights: dict[str, float] | None = None) -> DataFrame:
    """Dispatch by strategy.  Without model scores the model strategies fall back to score fusion."""
    if strategy == "similarity":
        return by_similarity(docs, k)
    if strategy == "model" and scores is not None:
        return by_scores(docs, scores, k)
    if strategy == "hybrid" and scores is not None:
        return hybrid(docs, k, lambda d, n: by_scores(d, scores, n))
    if strategy in ("score_fusion", "model", "hybrid"):
        return score_fusion(docs, k, weights)
    raise ValueError(f"unknown rerank strategy: {strategy}")


def cache_key(query: Column, ids: Column, strategy: Column) -> Column:
    """Key of a memoised result: query, sorted ids and strategy."""
    return F.md5(F.concat_ws(":", query, F.array_join(F.array_sort(ids), ":"), strategy))
