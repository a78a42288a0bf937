"""An inverted index that is stored once and grows.

Postings lie in immutable segments, one per append, range partitioned and sorted by (field,
term, doc_id): a term found in a third of all documents is spread over many files, and a
search reads only the row groups of its terms.  Deleting writes the ids and the number of
the commit; postings of earlier segments then no longer count.  Term and field statistics are
merged with every commit, exactly as a rebuilt index would have them, so a search needs no
pass over the vocabulary.  ``compact`` folds the segments into one.

Each change becomes visible at once with its manifest (``sources/commits.py``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweir.functions.text import tokens
from corpusweir.operators import bm25
from corpusweir.session import bounded_broadcast
from corpusweir.sources.commits import CommitLog, Version

#: Small row groups, so that a term's postings are read without its neighbours'.
ROW_GROUP = 4 << 20
#: Up to so many query terms are pushed into the scans.
PRUNED_TERMS = 1000


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(field, doc_id, dl, term, tf) of rows (field, doc_id, dl, terms); a document is one row, so no shuffle."""
    for batch in batches:
        lists = batch.column("terms")
        words = lists.flatten().dictionary_encode()
        if not len(words):
            continue
        row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        n = len(words.dictionary)
        pairs, tf = np.unique(row * n + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
        at = pa.array(pairs // n)
        yield pa.RecordBatch.from_arrays(
            [batch.column(c).take(at) for c in ("field", "doc_id", "dl")] + [words.dictionary.take(pa.array(pairs % n)), pa.array(tf)],
            ["field", "doc_id", "dl", "term", "tf"],
        )


class StoredIndex:
    """An index at ``path``.  ``doc_id`` is the key of a document in all its fields."""

    def __init__(self, spark: SparkSession, path: str, doc_type: str = "bigint", tokenizer=tokens):
        self.log, self.tokenizer, self.doc_type = CommitLog(spark, path), tokenizer, doc_type
        self.forward_schema = f"field string, doc_id {doc_type}, terms array<string>, dl bigint"
        self.posting_schema = f"field string, doc_id {doc_type}, dl bigint, term string, tf bigint"
        self.term_schema = "field string, term string, df bigint, total_dl bigint"
        self.field_schema = "field string, n_docs bigint, avgdl double, mean_idf double"

    # ------------------------------------------------------------------ parts

    def _sorted(self, df: DataFrame, *by: str) -> str:
        part = self.log.new_part()
        ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
        ranged.write.option("parquet.block.size", ROW_GROUP).parquet(f"{self.log.path}/{part}")
        return part

    def _segment(self, rows: DataFrame) -> dict:
        """Documents by id, tokenised once, and their postings by term."""
        forward = self._sorted(bm25.tokenised(rows, self.tokenizer).select("field", "doc_id", "terms", "dl"), "doc_id", "field")
        read = self.log.read([forward], self.forward_schema)
        if not read.groupBy("doc_id", "field").count().filter("count > 1").isEmpty():
            self.log.folder.delete(forward)
            raise ValueError("a document occurs more than once in the rows to append")
        return {"forward": forward, "postings": self._postings(read)}

    def _postings(self, forward: DataFrame) -> str:
        rows = forward.select("field", "doc_id", "dl", "terms").mapInArrow(counted, self.posting_schema)
        return self._sorted(rows, "field", "term", "doc_id")

    def _live(self, content: dict, kind: str, schema: str) -> DataFrame:
        """Rows of all segments but those whose document was deleted by a later commit."""
        rows = None
        for segment in content.get("segments", []):
            part = self.log.read([segment[kind]], schema).withColumn("_segment", F.lit(segment["number"]))
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            return self.log.spark.createDataFrame([], schema)
        if content["deleted"]:
            gone = None
            for d in content["deleted"]:
                part = self.log.read([d["ids"]], f"doc_id {self.doc_type}").withColumn("_before", F.lit(d["number"]))
                gone = part if gone is None else gone.union(part)
            gone = bounded_broadcast(gone.groupBy("doc_id").agg(F.max("_before").alias("_before")))
            rows = rows.join(gone, "doc_id", "left").filter("_before is null or _segment >= _before").drop("_before")
        return rows.drop("_segment")

    def _counts(self, forward: DataFrame, sign: int) -> DataFrame:
        """Document counts per term; '' stands for the documents and has their length."""
        terms = F.explode(F.concat(F.array_distinct("terms"), F.array(F.lit(""))))
        return forward.select("field", "dl", terms.alias("term")).groupBy("field", "term").agg(
            (F.count("*") * sign).alias("df"), (F.sum(F.when(F.col("term") == "", F.col("dl"))) * sign).alias("total_dl")
        )

    def _statistics(self, content: dict, changes: list[DataFrame]) -> dict:
        merged = self.log.read([content["terms"]] if "terms" in content else [], self.term_schema)
        for change in changes:
            merged = merged.unionByName(change)
        merged = merged.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("total_dl").alias("total_dl")).filter("df > 0")
        terms = self._sorted(merged, "field", "term")
        fields = self.log.write(bm25.field_stats(self.log.read([terms], self.term_schema)).select("field", "n_docs", "avgdl", "mean_idf"))
        return {"terms": terms, "fields": fields}

    # ---------------------------------------------------------------- changes

    def append(self, rows: DataFrame, replace: bool = False) -> Version:
        """Adds ``rows(field, doc_id, text)``; with ``replace`` their documents' earlier rows go in the same commit."""
        made = self._segment(rows)
        forward = self.log.read([made["forward"]], self.forward_schema)
        ids = self.log.write(forward.select("doc_id").distinct()) if replace else None

        def change(base: Version) -> dict:
            number, content = base.number + 1, base.content
            changes = [self._counts(forward, 1)]
            if replace:
                changes.append(self._counts(self._of(content, ids), -1))
            return {
                "segments": [*content.get("segments", []), {**made, "number": number}],
                "deleted": [*content.get("deleted", []), *([{"ids": ids, "number": number}] if replace and base.number else [])],
                **self._statistics(content, changes),
            }

        return self.log.commit(change)

    def _of(self, content: dict, ids: str) -> DataFrame:
        wanted = bounded_broadcast(self.log.read([ids], f"doc_id {self.doc_type}"))
        return self._live(content, "forward", self.forward_schema).join(wanted, "doc_id", "left_semi")

    def delete(self, ids: DataFrame) -> Version:
        """Documents ``ids(doc_id)`` go; ids that are not there make no difference."""
        part = self.log.write(ids.select(F.col("doc_id").cast(self.doc_type)).filter("doc_id is not null").distinct())

        def change(base: Version) -> dict:
            content = {"segments": [], "deleted": []} | base.content
            return {
                "segments": content["segments"], "deleted": [*content["deleted"], {"ids": part, "number": base.number + 1}],
                **self._statistics(content, [self._counts(self._of(content, part), -1)]),
            }

        return self.log.commit(change)

    def compact(self) -> Version:
        """All that still counts in one segment."""

        def change(base: Version) -> dict:
            content = base.content
            forward = self._sorted(self._live(content, "forward", self.forward_schema), "doc_id", "field")
            postings = self._sorted(self._live(content, "postings", self.posting_schema), "field", "term", "doc_id")
            segment = {"forward": forward, "postings": postings, "number": base.number + 1}
            return content | {"segments": [segment], "deleted": []}

        return self.log.commit(change)

    # ----------------------------------------------------------------- search

    def stats(self, version: Version | None = None) -> bm25.CorpusStats:
        content = (version or self.log.latest()).content
        return bm25.CorpusStats(
            self.log.read([content["fields"]] if content else [], self.field_schema),
            self.log.read([content["terms"]] if content else [], self.term_schema),
        )

    def hits(self, terms: list[str] | DataFrame, version: Version | None = None) -> DataFrame:
        """Postings that count of the given terms; a list is pushed into the scans."""
        content = (version or self.log.latest()).content
        rows = self._live(content, "postings", self.posting_schema)
        return rows.filter(F.col("term").isin(terms)) if isinstance(terms, list) else rows.join(terms, "term", "left_semi")

    def search(self, queries: DataFrame, k: int | dict[str, int] = 50, version: Version | None = None) -> DataFrame:
        """Top ``k`` per (query, field) of ``queries(query_id, text)`` among positive scores, as ``search_fields`` ranks them."""
        version = version or self.log.latest()
        qterms = bm25.query_terms(queries, self.tokenizer)
        small = bm25.few_terms(qterms)
        stats = self.stats(version)
        wanted = qterms.select("term").distinct()
        short = [r["term"] for r in wanted.limit(PRUNED_TERMS + 1).collect()]
        if len(short) <= PRUNED_TERMS:
            wanted = short
            stats = bm25.CorpusStats(stats.fields, stats.terms.filter(F.col("term").isin(short)))
        elif small:
            wanted = F.broadcast(wanted)
        hits = self.hits(wanted, version)
        if isinstance(k, dict):
            hits = hits.filter(F.col("field").isin(list(k)))
        weighted = bm25.weighted_terms(qterms, stats, small)
        if not small:
            return bm25.best_per_field(bm25.score_hits(hits.repartition("field", "doc_id"), weighted, small), k)
        # Back to one row per document; only its postings of query terms are gathered.
        docs = hits.groupBy("field", "doc_id", "dl").agg(F.collect_list(F.struct("term", "tf")).alias("h")).select(
            "field", "doc_id", "dl", F.col("h.term").alias("terms"), F.col("h.tf").alias("tfs")
        )
        limit = k if isinstance(k, int) else max(k.values())
        scored = bm25.scored_locally(docs, bm25.QueryWeights.collect(weighted), queries.schema["query_id"].dataType, limit)
        return bm25.best_per_field(scored, k)
