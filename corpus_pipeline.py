"""From raw documents to packed training sequences.

Toxic documents go, repeated lines go, one document of every group of near-duplicates
stays, sources are mixed to their weights and the result is packed into sequences.  Each
stage reads what the one before it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusweir.llm.line_dedup import without_duplicate_lines
from corpusweir.llm.mixing import mixed
from corpusweir.llm.neardup import FIVE_WORDS, without_near_duplicates
from corpusweir.llm.packing import packed_sequences
from corpusweir.llm.tokens import public_path
from corpusweir.llm.toxicity import without_toxic
from corpusweir.session import ship_package, written_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model is fitted on the labelled ones."""
    ship_package(spark)
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of all lines that are nearly the same, the first one stays."""
    ship_package(spark)
    return without_duplicate_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    ship_package(spark)
    return without_near_duplicates(docs, FIVE_WORDS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget takes them, the last one cut."""
    ship_package(spark)
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 2048 tokens."""
    ship_package(spark)
    return packed_sequences(docs, public_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("packing", packing),
]

#: Learned scores and tokenisation cannot be stated in SQL; the stages are tested beside brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written_table(docs)
    return docs
