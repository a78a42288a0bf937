"""From ranked rows to the text handed to a generator, and what is reported back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusweir.functions.text import mean_of, snippet
from corpusweir.operators.topk import top_k

# Formats and texts that have to read the same.
BLOCK = "%d (来源: %s, 相关度: %.3f):\n%s\n"
UNKNOWN_SOURCE = "未知"
UNKNOWN_NAME = "未知文档"
DISCLAIMER = (
    "\n\n⚠️ 重要提醒：以上信息仅供参考，不能替代专业医疗建议。如有健康问题，请及时咨询专业医生或到医院就诊。"
)


def assemble(rows: DataFrame) -> DataFrame:
    """Numbered blocks per query and the mean relevance of the first three.

    ``rows(query_id, rank, source, relevance, content)`` is a final top-k list;
    the blocks are numbered without gaps, whatever ranks are left.
    """
    listed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", F.coalesce("source", F.lit(UNKNOWN_SOURCE)).alias("source"),
        F.coalesce("relevance", F.lit(0.0)).alias("relevance"), F.coalesce("content", F.lit("")).alias("content"),
    ))).alias("d"))

    def block(s, i):
        return F.format_string(BLOCK, i + 1, s["source"], s["relevance"], s["content"])

    return listed.select(
        "query_id", F.array_join(F.transform("d", block), "\n").alias("context"),
        mean_of(F.transform(F.slice("d", 1, 3), lambda s: s["relevance"])).alias("confidence_score"),
    )


def with_disclaimer(response: Column) -> Column:
    return F.when(response.contains(DISCLAIMER), response).otherwise(F.concat(response, F.lit(DISCLAIMER)))


def prompt(template: str, question: Column, context: Column) -> Column:
    """Fill ``{query}`` and ``{context}`` of a template."""
    return F.replace(
        F.replace(F.lit(template), F.lit("{query}"), question), F.lit("{context}"), context
    )


def reference_snippets(rows: DataFrame, n: int = 3, length: int = 200) -> DataFrame:
    """First ``n`` rows per query with a snippet that always ends in an ellipsis."""
    return rows.filter(F.col("rank") <= n).withColumn(
        "snippet", F.concat(F.substring("content", 1, length), F.lit("..."))
    )


def distinct_sources(rows: DataFrame, n: int = 3) -> DataFrame:
    """First ``n`` documents per query, each by its best row; rows without a document stay."""
    w = Window.partitionBy("query_id", "document_id").orderBy("rank")
    kept = rows.withColumn("_nth", F.row_number().over(w)).filter(
        (F.col("_nth") == 1) | (F.coalesce("document_id", F.lit("")) == "")
    )
    return top_k(kept.drop("_nth"), ["query_id"], [F.asc("rank")], n, "source_rank")


def display_name(meta: dict[str, Column], document_id: Column, doc_meta_name: Column, doc_title: Column,
                 doc_path: Column) -> Column:
    """First usable name: chunk metadata, then the document row, then a fixed default."""
    def usable(c):
        return F.nullif(c, F.lit(""))

    def unless_id(c):
        return F.when(~c.eqNullSafe(document_id), usable(c))

    return F.coalesce(
        usable(meta["file_name"]), unless_id(meta["source"]), unless_id(meta["title"]),
        usable(meta["original_filename"]), usable(meta["filename"]),
        usable(doc_meta_name), usable(doc_title), usable(F.element_at(F.split(doc_path, "/"), -1)),
        F.lit(UNKNOWN_NAME),
    )


def short(text: Column, n: int = 200) -> Column:
    return snippet(text, n)
