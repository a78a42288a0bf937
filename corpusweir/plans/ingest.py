"""From documents to searchable parents and children."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweir.functions.text import snippet, strip, token_line, tokens
from corpusweir.operators import chunking, cleaning, keywords, terminology
from corpusweir.plans.retrieval import Corpus
from corpusweir.session import written_table
from corpusweir.sources import files


@dataclass(frozen=True)
class Ingested:
    parents: DataFrame
    children: DataFrame
    stats: DataFrame


def parent_metadata(parents: DataFrame, n_keywords: int = 8) -> DataFrame:
    """Summary and keywords of every parent without a remote model.

    The summary is the leading sentence part, the keywords are the parent's most
    frequent longer words; a parent without text gets the fixed fallback.
    """
    frequent = keywords.frequent_terms(parents.select("parent_id", _longer().alias("terms")), ["parent_id"], n_keywords)
    lists = frequent.groupBy("parent_id").agg(  # at most n_keywords rows per parent
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("keywords")
    )
    joined = parents.join(lists, "parent_id", "left")
    return _summarised(joined).withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def row_metadata(parents: DataFrame, n_keywords: int = 8) -> DataFrame:
    """What ``parent_metadata`` gives for parents with ids of their own, inside the rows: no parent is shuffled."""
    return _summarised(keywords.with_frequent_terms(parents.withColumn("line", token_line(F.col("content"))), n_keywords, shortest=4))


def _longer() -> Column:
    return F.filter(tokens(F.col("content")), lambda t: F.length(t) > 3)


def _summarised(parents: DataFrame) -> DataFrame:
    fallback = F.format_string("文档片段 %d", F.col("parent_index") + 1)
    lead = snippet(F.col("content"), 200)
    return parents.withColumn("summary", F.when(strip(F.col("content")) != "", lead).otherwise(fallback))


def model_metadata(parents: DataFrame, replies: DataFrame) -> DataFrame:
    """Summary and keywords from model replies (parent_id, reply JSON); bad JSON falls back."""
    reply = F.from_json("reply", "summary string, keywords array<string>")
    joined = parents.join(replies.select("parent_id", reply.alias("_r")), "parent_id", "left")
    return joined.withColumns({
        "summary": F.coalesce(F.col("_r.summary"), F.format_string("文档片段 %d", F.col("parent_index") + 1)),
        "keywords": F.coalesce(F.col("_r.keywords"), F.array().cast("array<string>")),
    }).drop("_r")


def ingest(docs: DataFrame, clean: bool = True, standardise: bool = False,
           parent_size: int = chunking.PARENT_SIZE, child_size: int = chunking.CHILD_SIZE) -> Ingested:
    """``docs(doc_id, text)``: clean, standardise, split twice, describe the parents.

    The parents are written once to the shared folder; children, keywords and counts read them there,
    so texts are cleaned and split once.
    """
    out = docs.select("doc_id", "text")
    if clean:
        out = cleaning.clean_steps(out).select("doc_id", F.col("cleaned").alias("text"))
    if standardise:
        out = out.withColumn("text", terminology.standardiser()(F.col("text")))
    bare = written_table(chunking.packed_parents(out.filter("text <> ''"), parent_size))
    children = chunking.packed_children(bare, child_size)
    parents = parent_metadata(bare)
    inherited = children.join(parents.select("parent_id", "summary", "keywords"), "parent_id")
    return Ingested(parents, inherited, chunking.chunk_statistics(bare, children))


@dataclass(frozen=True)
class FilesIngested:
    ingested: Ingested
    documents: DataFrame
    rejects: DataFrame


def ingest_files(spark: SparkSession, path: str, glob: str | None = None, fallback: bool = True, **how) -> FilesIngested:
    """All files below ``path``: parsed, joined to documents, cleaned, standardised and split.

    Spark lists and reads the files, so any file system it knows will do.  Every file is opened
    once; its elements, at most one file's, are put in order again as one document, whose id is
    the md5 of its path.  ``how`` goes to ``ingest``, which cleans and standardises by default.
    """
    parsed = written_table(files.parse_all(files.read_files(spark, path, glob), fallback))
    in_order = F.array_sort(F.collect_list(F.struct("position", "text")))
    documents = parsed.filter("error is null").groupBy("path").agg(
        F.array_join(F.transform(in_order, lambda e: e["text"]), "\n\n").alias("text")
    ).select(F.md5("path").alias("doc_id"), "path", "text")
    done = ingest(documents, **{"standardise": True, **how})
    return FilesIngested(done, documents, parsed.filter("error is not null").select("path", "error"))


def as_corpus(ingested: Ingested, vectors: DataFrame) -> Corpus:
    """The retrieval inputs of an ingested collection."""
    children = ingested.children.select(
        F.col("chunk_id").alias("doc_id"), "parent_id", "content", "summary",
        F.array_join("keywords", " ").alias("keywords"),
    )
    return Corpus(children, ingested.parents.select("parent_id", "content", "summary", "keywords"), vectors)


def final_metadata(ingested: Ingested, key: str = "doc_id") -> DataFrame:
    """Chunk and character counts per document."""
    return ingested.parents.groupBy(key).agg(
        F.count("*").alias("total_chunks"), F.sum(F.length("content")).cast("long").alias("total_chars"))


def save(ingested: Ingested, path: str) -> None:
    """Write both chunk tables; a re-run replaces them."""
    ingested.parents.write.mode("overwrite").parquet(f"{path}/parent_chunks")
    ingested.children.write.mode("overwrite").parquet(f"{path}/child_chunks")
