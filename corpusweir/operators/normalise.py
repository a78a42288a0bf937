"""Score normalisers over whole score lists.

Group statistics are aggregated (map-side combine) and joined back, so a list
holding a third of all rows is never gathered into one task.  The scores are
read more than once: pass a table or a checkpoint, not an expensive plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweir.operators.ordering import positions
from corpusweir.session import bounded_broadcast


def _with_stats(df: DataFrame, keys: Sequence[str], score: str, *stats) -> DataFrame:
    # One row per list: broadcast when measured to be few, so the rows stay where
    # they are; else the join shuffles and AQE splits a hot list.
    return df.join(bounded_broadcast(df.groupBy(*keys).agg(F.count("*").alias("_n"), *stats)), list(keys))


def min_max(df: DataFrame, keys: Sequence[str], score: str = "score", out: str = "norm") -> DataFrame:
    """[0, 1] by list; a single score is kept, equal scores become 1."""
    joined = _with_stats(df, keys, score, F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    value = (
        F.when(F.col("_n") == 1, F.col(score))
        .when(span == 0, F.lit(1.0))
        .otherwise((F.col(score) - F.col("_lo")) / F.nullif(span, F.lit(0.0)))
    )
    return joined.withColumn(out, value).drop("_n", "_lo", "_hi")


def z_score(df: DataFrame, keys: Sequence[str], score: str = "score", out: str = "norm") -> DataFrame:
    """Population z-score; a single score is kept, zero deviation becomes 0."""
    joined = _with_stats(df, keys, score, F.avg(score).alias("_mu"), F.stddev_pop(score).alias("_sd"))
    value = (
        F.when(F.col("_n") == 1, F.col(score))
        .when(F.col("_sd") == 0, F.lit(0.0))
        .otherwise((F.col(score) - F.col("_mu")) / F.nullif(F.col("_sd"), F.lit(0.0)))
    )
    return joined.withColumn(out, value).drop("_n", "_mu", "_sd")


def by_rank(df: DataFrame, keys: Sequence[str], tie: str, score: str = "score", out: str = "norm"):
    """1 - rank/n with rank from 0, best score first."""
    ranked = positions(df, keys, [F.desc(score), F.asc(tie)], "_pos")
    joined = _with_stats(ranked, keys, score)
    return joined.withColumn(out, 1.0 - (F.col("_pos") - 1) / F.col("_n")).drop("_pos", "_n")
