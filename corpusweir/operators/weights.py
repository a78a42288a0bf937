"""Adaptive path weights from query traits and recorded performance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusweir.config import PATHS

# Fixed values.
LEARNING_RATE, MIN_WEIGHT, MAX_WEIGHT, PATTERN_BLEND = 0.1, 0.05, 0.7, 0.3
HISTORY_ROWS = 100
METRICS = ("precision_at_k", "recall_at_k", "response_time", "success_rate", "user_satisfaction",
           "relevance_score", "diversity_score")
METRIC_SHARES = {"precision_at_k": 0.25, "recall_at_k": 0.20, "success_rate": 0.15, "user_satisfaction": 0.10,
                 "relevance_score": 0.10, "diversity_score": 0.05}
RESPONSE_SHARE, WORST_SECONDS = 0.15, 5.0
TYPE_PATTERNS = {
    "factual": {"keywords": 0.4, "content": 0.3, "vector": 0.2, "summary": 0.1},
    "conceptual": {"vector": 0.45, "summary": 0.3, "keywords": 0.15, "content": 0.1},
    "procedural": {"content": 0.4, "keywords": 0.3, "vector": 0.2, "summary": 0.1},
    "comparative": {"vector": 0.35, "summary": 0.35, "keywords": 0.2, "content": 0.1},
}


def overall_score() -> Column:
    """Composite of the seven metrics; slow answers cost up to the response share."""
    quick = (1.0 - F.least(F.col("response_time") / WORST_SECONDS, F.lit(1.0))) * RESPONSE_SHARE
    return reduce(lambda a, b: a + b, [F.col(m) * w for m, w in METRIC_SHARES.items()]) + quick


def recent(history: DataFrame, n: int = HISTORY_ROWS, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Last ``n`` records per key (a window group limit, cut before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("record_id"))
    return history.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def context_matches(history: DataFrame, contexts: DataFrame) -> DataFrame:
    """Records whose context resembles the query's.

    ``history`` is cut to the last records per path, so the equi join on type
    and complexity meets a bounded number of rows per query.
    """
    h = history.withColumnRenamed("semantic_density", "_d")
    near = F.abs(F.col("_d") - F.col("semantic_density")) < 0.3
    return contexts.select("query_id", "query_type", "complexity", "semantic_density").join(
        h, ["query_type", "complexity"]
    ).filter(near)


def average_performance(records: DataFrame, keys: list[str]) -> DataFrame:
    return records.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in METRICS])


def path_rankings(contexts: DataFrame, history: DataFrame) -> DataFrame:
    """(query_id, path, score, place) over all four paths; no record scores like zeros."""
    zero = RESPONSE_SHARE  # composite of an all-zero record: nothing but the response share
    averages = average_performance(context_matches(recent(history), contexts), ["query_id", "path"]).select(
        "query_id", "path", overall_score().alias("score")
    )
    grid = contexts.select("query_id", F.posexplode(F.array(*[F.lit(p) for p in PATHS])).alias("i", "path"))
    scored = grid.join(averages, ["query_id", "path"], "left").withColumn(
        "score", F.round(F.coalesce("score", F.lit(zero)), 9)
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("i"))  # four rows per query
    return scored.withColumn("place", F.row_number().over(w) - 1).drop("i")


def by_performance(base: dict[str, float], rankings: DataFrame) -> DataFrame:
    """(query_id, p_<path>): better placed paths gain more."""
    n = len(PATHS)
    gain = LEARNING_RATE * (n - F.col("place")) / n * F.col("score")
    return rankings.groupBy("query_id").agg(*[
        (F.lit(base[p]) + F.sum(F.when(F.col("path") == p, gain).otherwise(0.0))).alias(f"p_{p}") for p in PATHS
    ])


def by_query(df: DataFrame, base: dict[str, float]) -> DataFrame:
    """``q_<path>`` from type pattern, complexity, density and special features.

    Needs query_type, complexity, semantic_density, has_entities, has_numbers, has_dates.
    """
    dense, level = F.col("semantic_density"), F.col("complexity")
    columns = {}
    for p in PATHS:
        w = F.lit(base[p])
        blended = F.lit(None).cast("double")
        for name, pattern in TYPE_PATTERNS.items():
            mixed = base[p] * (1 - PATTERN_BLEND) + pattern[p] * PATTERN_BLEND
            blended = F.when(F.col("query_type") == name, F.lit(mixed)).otherwise(blended)
        w = F.coalesce(blended, w)
        factors = {
            "vector": [(level == "simple", 0.9), (level == "complex", 1.3), (dense > 0.7, 1.2)],
            "keywords": [(level == "simple", 1.2), (level == "complex", 0.8), (dense < 0.3, 1.2),
                         (F.col("has_entities"), 1.1)],
            "summary": [(level == "complex", 1.1)],
            "content": [(F.col("has_numbers") | F.col("has_dates"), 1.2)],
        }[p]
        for condition, factor in factors:
            w = w * F.when(condition, factor).otherwise(1.0)
        columns[f"q_{p}"] = w
    return df.withColumns(columns)


def normalised(values: dict[str, Column]) -> dict[str, Column]:
    """Sum to one; equal shares when nothing is positive."""
    total = reduce(lambda a, b: a + b, values.values())
    share = 1.0 / len(values)
    return {k: F.when(total <= 0, F.lit(share)).otherwise(v / F.nullif(total, F.lit(0.0)))
            for k, v in values.items()}


def finish(df: DataFrame, values: dict[str, Column], prefix: str = "f_") -> DataFrame:
    """Normalise, clamp to the allowed range, normalise again."""
    df = df.withColumns({f"_n_{p}": c for p, c in normalised(values).items()})
    clamped = {p: F.greatest(F.lit(MIN_WEIGHT), F.least(F.lit(MAX_WEIGHT), F.col(f"_n_{p}"))) for p in values}
    df = df.withColumns({f"{prefix}{p}": c for p, c in normalised(clamped).items()})
    return df.drop(*[f"_n_{p}" for p in values])


def reinforcement(base: dict[str, float], feedback: DataFrame, last: int = 10) -> DataFrame:
    """One row of weights: mean reward of the last adjustments against a baseline of 0.5.

    ``feedback(adjustment_id, ts, path, <metrics>)``; the last ``last`` adjustments
    are found first, so the rest is a semi join with at most ``last`` rows.
    """
    newest = feedback.groupBy("adjustment_id").agg(F.max("ts").alias("_t")).orderBy(
        F.desc("_t"), F.desc("adjustment_id")
    ).limit(last)
    rewards = feedback.join(F.broadcast(newest), "adjustment_id", "left_semi").withColumn("r", overall_score())
    return rewards.agg(*[
        (F.lit(base[p]) + LEARNING_RATE * F.coalesce(F.avg(F.when(F.col("path") == p, F.col("r"))) - 0.5,
                                                      F.lit(0.0))).alias(p)
        for p in PATHS
    ])


def adjust(contexts: DataFrame, base: dict[str, float], strategy: str = "hybrid",
           history: DataFrame | None = None, has_feedback: bool = False,
           feedback: DataFrame | None = None) -> DataFrame:
    """``f_<path>`` weights of every query by ``strategy``."""
    if strategy == "reinforcement":
        if feedback is None:
            raise ValueError("this strategy needs recorded feedback")
        learned = reinforcement(base, feedback)  # one row, read as scalars
        df = contexts.withColumns({f"_l_{p}": learned.select(p).scalar() for p in PATHS})
        return finish(df, {p: F.col(f"_l_{p}") for p in PATHS}).drop(*[f"_l_{p}" for p in PATHS])
    df = by_query(contexts, base)
    if strategy == "query_aware":
        return finish(df, {p: F.col(f"q_{p}") for p in PATHS})
    if strategy in ("performance_based", "hybrid"):
        if history is None:
            raise ValueError("this strategy needs a performance history")
        df = df.join(by_performance(base, path_rankings(contexts, history)), "query_id")
        if strategy == "performance_based":
            return finish(df, {p: F.col(f"p_{p}") for p in PATHS})
        share = 0.6 if has_feedback else 0.3
        return finish(df, {p: F.col(f"p_{p}") * share + F.col(f"q_{p}") * (1 - share) for p in PATHS})
    raise ValueError(f"unknown strategy: {strategy}")


def adaptation_stats(adjustments: DataFrame, now: Column) -> DataFrame:
    """Per path: mean change; with the strategy histogram and the last hour's count.

    ``adjustments(adjustment_id, ts, strategy, path, original, adjusted)``.
    """
    age = now.cast("double") - F.col("ts").cast("double")
    return adjustments.groupBy("strategy", "path").agg(
        F.count("*").alias("adjustments"),
        F.avg(F.col("adjusted") - F.col("original")).alias("average_change"),
        F.count_if(age < 3600).alias("recent_adjustments"),
    )
