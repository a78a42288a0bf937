"""Small-to-big operators: one child per parent, then the parent in its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusweir.operators.topk import rerank_dense
from corpusweir.session import lookup_join


def parent_id(meta: Column, top_level: Column) -> Column:
    """Parent from the metadata, else from the row; an empty id is no id."""
    return F.coalesce(F.nullif(meta, F.lit("")), F.nullif(top_level, F.lit("")))


def dedup_parents(lists: DataFrame) -> DataFrame:
    """Best ranked child per (query, path, parent); rows without a parent stay.

    Ranks are made dense again afterwards.  The lists are top-k results.
    """
    w = Window.partitionBy("query_id", "path", "parent_id").orderBy("rank")
    kept = lists.withColumn("_nth", F.row_number().over(w)).filter(
        (F.col("_nth") == 1) | F.col("parent_id").isNull()
    )
    return rerank_dense(kept.drop("_nth"), ["query_id", "path"], [F.asc("rank")])


def dedup_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts per path and in total (path null), from one rollup."""
    tagged = before.select("path", F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(
        after.select("path", F.lit(0).alias("b"), F.lit(1).alias("a"))
    )
    out = tagged.rollup("path").agg(
        F.sum("b").cast("long").alias("original_count"), F.sum("a").cast("long").alias("deduplicated_count")
    )
    removed = F.col("original_count") - F.col("deduplicated_count")
    return out.withColumn("removed_count", removed).withColumn(
        "deduplication_rate", removed / F.greatest(F.col("original_count"), F.lit(1))
    )


def parent_distribution(lists: DataFrame) -> DataFrame:
    """Per parent: the paths that reached it and how many children came along."""
    return (
        lists.filter(F.col("parent_id").isNotNull())
        .groupBy("parent_id", "path").agg(F.count("*").alias("n"))
        .groupBy("parent_id")
        .agg(
            F.concat_ws(",", F.array_sort(F.collect_list("path"))).alias("paths"),
            F.count("*").alias("path_count"),
            F.sum("n").cast("long").alias("total_small_chunks"),
        )
    )


def switch_to_parents(children: DataFrame, parents: DataFrame, preserve: bool = False,
                      few: bool | None = None, unique: bool = False) -> DataFrame:
    """Replace a child's content by its parent's, keeping every score.

    ``children`` are the few rows of ranked lists; the parents are the large
    side and are reached by an equi join on their id.  ``few`` says that the
    children are known to be few (else they are counted).  ``unique`` keeps one
    row per parent and query where several children lead to the same parent.
    """
    big = parents.select(
        F.col("parent_id"), F.col("content").alias("_content"),
        F.col("summary").alias("parent_summary"), F.col("keywords").alias("parent_keywords"),
    )
    joined = lookup_join(
        children.withColumn("original_id", F.col("doc_id")), big, "parent_id",
        "left" if preserve else "inner", few,
    )
    if unique:
        w = Window.partitionBy("query_id", "parent_id").orderBy("rank")
        first = F.row_number().over(w) == 1
        joined = joined.withColumn("_first", first | F.col("_content").isNull()).filter("_first").drop("_first")
    return (
        joined.withColumn("switched_to_parent", F.col("_content").isNotNull())
        .withColumn("content", F.coalesce("_content", "content"))
        .drop("_content")
    )


def switch_stats(children: DataFrame, parents: DataFrame, preserve: bool = False) -> DataFrame:
    """Found / missing / kept counts; every child is counted once in the total."""
    marked = lookup_join(children, parents.select("parent_id", F.lit(True).alias("_hit")), "parent_id", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    named = F.col("parent_id").isNotNull()
    kept = ~hit & F.lit(preserve)
    out = marked.agg(
        F.count("*").alias("total_processed"),
        F.count_if(hit).alias("parent_chunks_found"),
        F.count_if(~hit & named).alias("parent_chunks_missing"),
        F.count_if(kept).alias("small_chunks_kept"),
    )
    return out.withColumn(
        "switch_success_rate",
        F.col("parent_chunks_found") / F.greatest(F.col("total_processed"), F.lit(1)),
    )
