"""Fusion of ranked lists: rows (query_id, path, rank, doc_id, score).

All lists are top-k results, so every group here is bounded by the number of
paths times k; one shuffle on (query_id) serves grouping and ranking because the
first grouping by (query_id, doc_id) already combines map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusweir.config import DEFAULT_WEIGHTS
from corpusweir.operators.topk import stable_score, top_k

RRF_K = 60


def first_score(df: DataFrame) -> Column:
    """First non-zero of bm25, similarity and generic score, else the rerank score."""
    have = [c for c in ("bm25_score", "similarity_score", "score") if c in df.columns]
    picks = [F.nullif(F.col(c), F.lit(0.0)) for c in have]
    if "rerank_score" in df.columns:
        picks.append(F.col("rerank_score"))
    return F.coalesce(*picks, F.lit(0.0))


def weight_of(path: Column, weights: dict[str, float]) -> Column:
    """Weight literal of a path; null for a path that has none."""
    return F.coalesce(*[F.when(path == name, F.lit(float(w))) for name, w in weights.items()])


def normalised_in_list(df: DataFrame) -> Column:
    """Min-max inside a (query, path) list of top-k size."""
    w = Window.partitionBy("query_id", "path")
    lo, hi, n = F.min("score").over(w), F.max("score").over(w), F.count("*").over(w)
    return (
        F.when(n == 1, F.col("score"))
        .when(hi == lo, F.lit(1.0))
        .otherwise((F.col("score") - lo) / F.nullif(hi - lo, F.lit(0.0)))
    )


def _weighted(lists: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """Lists with a ``weight`` column: given per row, by path, or equal shares."""
    if "weight" in lists.columns:
        out = lists
    elif weights is None:
        paths = F.size(F.collect_set("path").over(Window.partitionBy("query_id")))
        out = lists.withColumn("weight", 1.0 / paths)
    else:
        out = lists.withColumn("weight", weight_of(F.col("path"), weights))
    return out.filter(F.col("weight") > 0)


def weighted_rrf(lists: DataFrame, weights: dict[str, float] | None = None, k: int = RRF_K,
                 top: int = 20, keep: int | None = None, normalise: bool = True, extra: tuple = ()) -> DataFrame:
    """Sum of weight/(k+rank); ``path_contributions`` explains every document."""
    rows = _weighted(lists, weights)
    rows = rows.withColumn("_norm", normalised_in_list(rows) if normalise else F.col("score"))
    fused = rows.groupBy("query_id", "doc_id").agg(
        stable_score(F.sum(F.col("weight") / (F.lit(k) + F.col("rank")))).alias("fusion_score"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct(
                "path", F.struct("rank", F.col("_norm").alias("score"), "weight")
            )))
        ).alias("path_contributions"),
        *extra,
    )
    return top_k(fused, ["query_id"], [F.desc("fusion_score"), F.asc("doc_id")], keep or top)


def simple_rrf(lists: DataFrame, k: int = RRF_K, top: int = 20, extra: tuple = ()) -> DataFrame:
    return weighted_rrf(lists.withColumn("weight", F.lit(1.0)), k=k, top=top, normalise=False, extra=extra)


def weighted_sum(lists: DataFrame, weights: dict[str, float] | None = None, top: int = 20,
                 extra: tuple = ()) -> DataFrame:
    rows = _weighted(lists, weights)
    fused = rows.withColumn("_norm", normalised_in_list(rows)).groupBy("query_id", "doc_id").agg(
        stable_score(F.sum(F.col("weight") * F.col("_norm"))).alias("fusion_score"), *extra
    )
    return top_k(fused, ["query_id"], [F.desc("fusion_score"), F.asc("doc_id")], top)


def max_score(lists: DataFrame, top: int = 20, extra: tuple = ()) -> DataFrame:
    fused = lists.groupBy("query_id", "doc_id").agg(
        F.greatest(F.max("score"), F.lit(0.0)).alias("fusion_score"), *extra
    )
    return top_k(fused, ["query_id"], [F.desc("fusion_score"), F.asc("doc_id")], top)


def fuse(method: str, lists: DataFrame, weights: dict[str, float] | None = None, top: int = 20,
         k: int = RRF_K, extra: tuple = ()) -> DataFrame:
    """Dispatch by method name; ``extra`` are further aggregates per document."""
    if method == "weighted_rrf":
        return weighted_rrf(lists, weights, k, top, extra=extra)
    if method == "simple_rrf":
        return simple_rrf(lists, k, top, extra)
    if method == "weighted_sum":
        return weighted_sum(lists, weights, top, extra)
    if method == "max_score":
        return max_score(lists, top, extra)
    raise ValueError(f"unsupported fusion method: {method}")


def outer_merge(lists: DataFrame, paths: tuple[str, ...] = tuple(DEFAULT_WEIGHTS)) -> DataFrame:
    """Union of ids with one rank and one score column per path (a pivot, not a join chain)."""
    cols = []
    for p in paths:
        here = F.col("path") == p
        cols += [F.max(F.when(here, F.col("rank"))).alias(f"{p}_rank"),
                 F.max(F.when(here, F.col("score"))).alias(f"{p}_score")]
    return lists.groupBy("query_id", "doc_id").agg(*cols)


def diversity_penalty(fused: DataFrame, words: Column, factor: float = 0.1, top: int = 20) -> DataFrame:
    """Lower a score by its largest Jaccard overlap with a better ranked document.

    ``fused`` is a top-k result, so the array gathered per query is bounded by
    that k; the comparison runs inside the row, without a self join.
    """
    listed = fused.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(
            "rank", "doc_id", "fusion_score", F.array_distinct(words).alias("w")
        ))).alias("docs")
    )

    def overlap(a, b):
        inter = F.size(F.array_intersect(a, b))
        union = F.size(a) + F.size(b) - inter
        return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
            inter / F.nullif(union, F.lit(0))
        )

    def penalised(d):
        better = F.filter(F.col("docs"), lambda o: o["rank"] < d["rank"])
        most = F.coalesce(F.array_max(F.transform(better, lambda o: overlap(o["w"], d["w"]))), F.lit(0.0))
        return F.struct(d["doc_id"].alias("doc_id"), d["fusion_score"].alias("original_score"),
                        (most * factor).alias("diversity_penalty"))

    rows = listed.select("query_id", F.explode(F.transform("docs", penalised)).alias("d")).select(
        "query_id", "d.*"
    )
    rows = rows.withColumn(
        "fusion_score", stable_score(F.col("original_score") * (1.0 - F.col("diversity_penalty")))
    )
    return top_k(rows, ["query_id"], [F.desc("fusion_score"), F.asc("doc_id")], top)
