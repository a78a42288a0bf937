"""From questions to prompts in one plan: variants, nested fusion, parents, context.

A question is asked in several variants.  Within a path the lists of its variants are fused by
rank first, so a child that several variants find moves up and no variant counts more than
another; then the paths are fused as for any query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweir.config import RetrievalConfig
from corpusweir.operators import analysis, context, parents
from corpusweir.operators.topk import stable_score, top_k
from corpusweir.plans import retrieval as plan
from corpusweir.session import checkpointed, is_few

TEMPLATE = "{context}\n\nQ: {query}"


def variants(questions: DataFrame, expand: Callable[[Column], Column] = analysis.expand) -> DataFrame:
    """``query_id, question_id, text``: a row per variant, the question itself included."""
    each = questions.select(F.col("query_id").alias("question_id"), F.posexplode(expand(F.col("text"))).alias("_pos", "text"))
    return each.select(F.concat_ws("#", "question_id", "_pos").alias("query_id"), "question_id", "text")


def fused_variants(lists: DataFrame, asked: DataFrame, limits: dict[str, int], k: int = 60) -> DataFrame:
    """One list per question and path from those of its variants.

    ``lists`` are those of ``asked(query_id, question_id)``; the score that stays is the best one.
    """
    rows = lists.join(asked.select("query_id", "question_id"), "query_id")
    fused = rows.groupBy(F.col("question_id").alias("query_id"), "path", "doc_id").agg(
        stable_score(F.sum(1.0 / (F.lit(k) + F.col("rank")))).alias("_fused"), F.max("score").alias("score"), F.first("parent_id").alias("parent_id")
    )
    longest = max(limits.values())
    ranked = top_k(fused, ["query_id", "path"], [F.desc("_fused"), F.asc("doc_id")], longest)
    limit = F.coalesce(*[F.when(F.col("path") == p, F.lit(n)) for p, n in limits.items()], F.lit(longest))
    return ranked.filter(F.col("rank") <= limit).drop("_fused")


def prompts(
    corpus: plan.Corpus, questions: DataFrame, vectorised: Callable[[DataFrame], DataFrame], config: RetrievalConfig = RetrievalConfig(),
    top: int = 5, template: str = TEMPLATE, expand: Callable[[Column], Column] = analysis.expand,
) -> DataFrame:
    """``query_id, prompt, context, confidence_score, n_variants``; a question without hits has an empty context.

    ``vectorised`` adds ``embedding`` to rows with a ``text``.
    """
    asked = checkpointed(variants(questions, expand))
    lists = plan.ranked_lists(corpus, vectorised(asked.select("query_id", "text")), config)
    nested = fused_variants(lists, asked, config.top_ks(), config.fusion.rrf_k)
    best = checkpointed(plan.final_list(nested, corpus, config).filter(F.col("rank") <= top))
    few = is_few(best)
    rows = parents.switch_to_parents(plan.with_text(best, corpus, few), corpus.parents, few=few)
    found = context.assemble(rows.withColumn("source", F.split_part("parent_id", F.lit("-"), F.lit(1))).withColumn("relevance", F.col("fused_rerank_score")))
    counted = asked.groupBy(F.col("question_id").alias("query_id")).agg(F.count("*").alias("n_variants"))
    out = questions.select("query_id", "text").join(found, "query_id", "left").join(counted, "query_id", "left").withColumn(
        "context", F.coalesce("context", F.lit(""))
    )
    return out.select(
        "query_id", context.prompt(template, F.col("text"), F.col("context")).alias("prompt"), "context",
        F.coalesce("confidence_score", F.lit(0.0)).alias("confidence_score"), F.coalesce("n_variants", F.lit(0)).cast("long").alias("n_variants"),
    )
