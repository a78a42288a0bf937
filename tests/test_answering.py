"""Variants of a question: nested rank fusion and prompts beside literals."""

from pyspark.sql import functions as F

from corpusweir.plans import answering
from corpusweir.plans.retrieval import Corpus
from corpusweir.sources.models import hashed_vectors


def test_lists_of_variants_are_fused_by_rank(spark):
    lists = spark.createDataFrame([
        ("7#0", "content", 1, "a", "pa", 9.0), ("7#0", "content", 2, "b", "pb", 8.0), ("7#1", "content", 1, "b", "pb", 3.0),
        ("7#1", "content", 2, "c", None, 2.0), ("7#0", "vector", 1, "a", "pa", 0.5), ("8#0", "content", 1, "c", None, 1.0),
    ], "query_id string, path string, rank long, doc_id string, parent_id string, score double")
    asked = spark.createDataFrame([("7#0", 7), ("7#1", 7), ("8#0", 8)], "query_id string, question_id long")
    got = answering.fused_variants(lists, asked, {"content": 2, "vector": 5}).orderBy("query_id", "path", "rank")
    assert [(r.query_id, r.path, r.rank, r.doc_id, r.parent_id, r.score) for r in got.collect()] == [
        # b: 1/62 + 1/61, a: 1/61, c: 1/62 and beyond the limit.
        (7, "content", 1, "b", "pb", 8.0), (7, "content", 2, "a", "pa", 9.0), (7, "vector", 1, "a", "pa", 0.5), (8, "content", 1, "c", None, 1.0),
    ]


def test_a_question_becomes_a_prompt(spark):
    children = spark.createDataFrame(
        [(f"{i}-0-0", f"{i}-0", text, text[:10], text.split()[0]) for i, text in enumerate(["red apples grow", "green pears fall", "blue plums rest", "apples and pears"])],
        "doc_id string, parent_id string, content string, summary string, keywords string")
    parents = children.select("parent_id", F.concat(F.lit("whole "), "content").alias("content"), "summary", "keywords")
    vectors = hashed_vectors(children, "content").select("doc_id", "embedding")
    questions = spark.createDataFrame([(1, "apples"), (2, "nothing?"), (3, "")], "query_id long, text string")
    twice = lambda text: F.when(text == "", F.array()).otherwise(F.array(text, F.concat(text, F.lit(" red"))))
    out = answering.prompts(Corpus(children, parents, vectors), questions, lambda rows: hashed_vectors(rows, "text"), top=1,
                            template="{query} <- {context}", expand=twice)
    got = {r.query_id: r for r in out.collect()}
    assert got[1].prompt.startswith("apples <- 1 (来源: 0, 相关度: ") and "whole red apples grow" in got[1].prompt and got[1].n_variants == 2
    assert got[3].prompt == " <- " and got[3].n_variants == 0 and got[3].confidence_score == 0.0


def test_variants_keep_the_question(spark):
    rows = answering.variants(spark.createDataFrame([(1, "x"), (2, "why?")], "query_id long, text string")).collect()
    assert {r.text for r in rows if r.question_id == 1} >= {"x"} and len({r.query_id for r in rows}) == len(rows)
    assert [r.text for r in rows if r.question_id == 2] == ["why?"]
