"""Per-field Okapi BM25 for a batch of queries.

Ranked search (``search_fields``, ``search_index``) never emits query/document
pairs: the weights of the query terms are broadcast, a task scores its documents
against all queries in Arrow batches, keeps ``k`` candidates per query and field
and shuffles only those.  A document is one row, so scanning the corpus needs no
shuffle at all; a saved index is read by term and regrouped by document.

Complete score maps (``all_scores``), and query sets too large to broadcast, go
through joins: hits are hash partitioned by (field, doc_id), which also serves the
grouping by (query_id, field, doc_id), so the expansion to pairs stays in its stage.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusweir.functions.text import line_tokens, token_line, token_lists, tokens
from corpusweir.operators.topk import SCORE_DIGITS, stable_score, top_k
from corpusweir.operators.topkeeper import TopKeeper
from corpusweir.session import BROADCAST_ROWS

# Defaults of the Okapi variant used (fixed values).
K1 = 1.5
B = 0.75
EPSILON = 0.25


@dataclass(frozen=True)
class CorpusStats:
    """``fields``: (field, n_docs, avgdl, mean_idf); ``terms``: (field, term, df, total_dl).

    The term '' stands for the documents themselves: its df is their number and
    only it has a ``total_dl``.
    """

    fields: DataFrame
    terms: DataFrame


def field_rows(corpus: DataFrame, fields: dict[str, str | Column], doc_id: str = "doc_id") -> DataFrame:
    """One row per (document, field) with the field's text.

    List-valued fields are joined by a space.  A missing field is an empty text:
    the document still counts in the corpus size and in the mean length.
    """
    texts = [
        F.struct(
            F.lit(name).alias("field"),
            F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).alias("text"),
        )
        for name, c in fields.items()
    ]
    return corpus.select(F.col(doc_id).alias("doc_id"), F.explode(F.array(*texts)).alias("f")).select(
        "doc_id", "f.field", "f.text"
    )


def tokenised(rows: DataFrame, tokenizer=tokens) -> DataFrame:
    """(field, doc_id, dl, terms); ``tokenizer`` maps a text column to an array column."""
    arrays = rows.select("field", "doc_id", tokenizer(F.col("text")).alias("terms"))
    return arrays.withColumn("dl", F.size("terms").cast("long"))


def query_terms(queries: DataFrame, tokenizer=tokens) -> DataFrame:
    """(query_id, term, qtf); repeated query terms count repeatedly."""
    return (
        queries.select("query_id", F.explode_outer(tokenizer(F.col("text"))).alias("term"))
        .filter("term is not null")
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("qtf"))
    )


def raw_idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs - df + 0.5) / (df + 0.5))


def corpus_stats(toks: DataFrame) -> CorpusStats:
    """Statistics from one scan of the corpus.

    Documents are counted beside their terms, and everything below is built on
    the one shuffle by (field, term): conditional aggregates and inner joins are
    used where a filter would be pushed below it and force another scan.
    """
    terms = (
        toks.select("field", "dl", F.explode(F.concat(F.array_distinct("terms"), F.array(F.lit("")))).alias("term"))
        .groupBy("field", "term")
        .agg(F.count("*").alias("df"), F.sum(F.when(F.col("term") == "", F.col("dl"))).alias("total_dl"))
    )
    return CorpusStats(field_stats(terms), terms)


def line_terms(rows: DataFrame) -> DataFrame:
    """``CorpusStats.terms`` of ``rows(field, line, n)``: a row stands for ``n`` documents with the tokens of its ``token_line``.

    Terms are counted a batch of rows at a time, so a batch's distinct terms are shuffled, not its tokens.
    """
    names = ["field", "term", "df", "total_dl"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = batch.column("field").dictionary_encode()
            of, n = fields.indices.to_numpy(zero_copy_only=False), batch.column("n").to_numpy(zero_copy_only=False)
            lists = token_lists(batch.column("line"))
            dl = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            terms = lists.flatten().dictionary_encode()
            known = len(terms.dictionary)
            place = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64) * known
            pairs = np.sort(place + terms.indices.to_numpy(zero_copy_only=False))
            row, term = np.divmod(pairs[np.diff(pairs, prepend=-1) > 0], max(known, 1))
            for i, name in enumerate(fields.dictionary.to_pylist()):
                rows_of, mine = of == i, of[row] == i
                met = np.flatnonzero(np.bincount(term[mine], minlength=known))
                df = np.bincount(term[mine], weights=n[row[mine]], minlength=known)[met].astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array([name] * (len(met) + 1), pa.string()),
                    pa.concat_arrays([terms.dictionary.take(pa.array(met)), pa.array([""], pa.string())]),
                    pa.array([*df, n[rows_of].sum()], pa.int64()),
                    pa.array([*[None] * len(met), (dl[rows_of] * n[rows_of]).sum()], pa.int64()),
                ], names)

    counted = rows.mapInArrow(run, "field string, term string, df long, total_dl long")
    return counted.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("total_dl").alias("total_dl"))


def field_stats(terms: DataFrame) -> DataFrame:
    """(field, n_docs, avgdl, mean_idf) of ``CorpusStats.terms``."""
    whole = F.col("term") == ""
    # Terms per document frequency: few rows to which the corpus size is joined.
    spectrum = terms.groupBy("field", "df").agg(
        F.count_if(~whole).alias("n_terms"), F.max(F.when(whole, F.col("df"))).alias("_n"),
        F.max("total_dl").alias("_dl"),
    )
    # d different frequencies need at least d*d/2 postings, so a field's part of
    # the spectrum stays small enough for one window task at any corpus size.
    of_field = Window.partitionBy("field")
    n = F.max("_n").over(of_field)
    sized = spectrum.select("field", "df", "n_terms", n.alias("n_docs"), (F.max("_dl").over(of_field) / n).alias("avgdl"))
    return sized.groupBy("field").agg(
        F.first("n_docs").alias("n_docs"), F.first("avgdl").alias("avgdl"),
        (F.sum(F.col("n_terms") * raw_idf(F.col("n_docs"), F.col("df")))
         / F.nullif(F.sum("n_terms"), F.lit(0))).alias("mean_idf"),
    )


def _hinted(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def few_terms(qterms: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Measured once per batch: every side derived from the query terms is at
    most a few times (one row per field) as long as the terms themselves."""
    return qterms.limit(limit + 1).count() <= limit


def weighted_terms(qterms: DataFrame, stats: CorpusStats, small: bool, epsilon: float = EPSILON) -> DataFrame:
    """Query terms with the idf of every field in which they occur."""
    wanted = _hinted(qterms.select("term").distinct(), small)
    # The condition on the aggregate keeps both uses of ``terms`` on one shuffle.
    known = stats.terms.filter("total_dl is null").join(wanted, "term").join(F.broadcast(stats.fields), "field")
    idf = raw_idf(F.col("n_docs"), F.col("df"))
    known = known.select(
        "field", "term", "avgdl",
        F.when(idf < 0, F.lit(epsilon) * F.col("mean_idf")).otherwise(idf).alias("idf"),
    )
    return known.join(_hinted(qterms, small), "term").select(
        "query_id", "field", "term", "qtf", "idf", "avgdl"
    )


def hits_from_text(toks: DataFrame, qterms: DataFrame, small: bool) -> DataFrame:
    """(field, doc_id, dl, term, tf) of query terms, partitioned by (field, doc_id)."""
    wanted = _hinted(qterms.select("term").distinct(), small)
    # explode_outer: for explode the optimizer would tokenise once more to skip
    # empty lists; the semi join drops their null term anyway.
    return (
        toks.select("field", "doc_id", "dl", F.explode_outer("terms").alias("term"))
        .join(wanted, "term", "left_semi")
        .repartition("field", "doc_id")
        .groupBy("field", "doc_id", "dl", "term")
        .agg(F.count("*").alias("tf"))
    )


def score_hits(hits: DataFrame, wterms: DataFrame, small: bool, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, field, doc_id, score) for every document holding a query term."""
    tf, dl, avgdl = F.col("tf"), F.col("dl"), F.col("avgdl")
    part = (
        F.col("qtf") * F.col("idf") * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * dl / avgdl))
    )
    return (
        hits.join(_hinted(wterms, small), ["field", "term"])
        .groupBy("query_id", "field", "doc_id")
        .agg(stable_score(F.sum(part)).alias("score"))
    )


def all_scores(rows: DataFrame, queries: DataFrame, tokenizer=tokens, **params) -> DataFrame:
    """Score map of every field, unfiltered (documents without a hit score 0)."""
    toks = tokenised(rows, tokenizer)
    qterms = query_terms(queries, tokenizer)
    small = few_terms(qterms)
    wterms = weighted_terms(qterms, corpus_stats(toks), small)
    return score_hits(hits_from_text(toks, qterms, small), wterms, small, **params)


@dataclass(frozen=True)
class QueryWeights:
    """Weights of all query terms, rows of a sparse matrix keyed by (field, term).

    Row ``f * len(terms) + t`` spans ``starts[row]:starts[row + 1]`` of
    ``queries`` (positions in ``query_ids``) and ``weights``.
    """

    query_ids: list
    fields: list[str]
    avgdl: np.ndarray
    terms: pa.Array
    starts: np.ndarray
    queries: np.ndarray
    weights: np.ndarray

    def shared_terms(self, field: int) -> tuple[np.ndarray, np.ndarray]:
        """(column of every term or -1, weights [column, query]) of the terms that most queries name."""
        row = field * len(self.terms) + np.arange(len(self.terms))
        fan = self.starts[row + 1] - self.starts[row]
        most = np.argsort(-fan, kind="stable")[:min(SHARED_TERMS, PAIRS_IN_MEMORY // max(len(self.query_ids), 1))]
        most = most[fan[most] >= SHARED_BY]
        columns = np.full(len(self.terms), -1)
        columns[most] = np.arange(len(most))
        matrix = np.zeros((len(most), len(self.query_ids)))
        for column, r in enumerate(row[most]):
            entries = slice(self.starts[r], self.starts[r + 1])
            matrix[column, self.queries[entries]] = self.weights[entries]
        return columns, matrix

    @staticmethod
    def collect(wterms: DataFrame) -> QueryWeights:
        """``wterms`` was measured to be small (``few_terms``)."""
        pdf = wterms.toPandas()
        qcodes, query_ids = pdf["query_id"].factorize()
        fcodes, fields = pdf["field"].factorize()
        tcodes, terms = pdf["term"].factorize()
        rows = fcodes.astype(np.int64) * max(len(terms), 1) + tcodes
        order = np.argsort(rows, kind="stable")
        starts = np.searchsorted(rows[order], np.arange(len(fields) * len(terms) + 1))
        avgdl = pdf.groupby("field")["avgdl"].first().reindex(fields).to_numpy(float)
        weights = (pdf["qtf"] * pdf["idf"]).to_numpy(float)
        return QueryWeights(list(query_ids), list(fields), avgdl, pa.array(list(terms), pa.string()), starts,
                            qcodes[order].astype(np.int64), weights[order])


PAIRS_IN_MEMORY = 4_000_000
#: Terms named by this many queries are multiplied as a dense matrix, up to so many of them.
SHARED_BY, SHARED_TERMS = 4, 256


def _term_counts(doc: np.ndarray, term: np.ndarray, tf: np.ndarray | None, n_terms: int):
    """(doc, term, tf) with one row per pair."""
    if tf is not None:
        return doc, term, tf
    pairs, counts = np.unique(doc * n_terms + term, return_counts=True)
    return pairs // n_terms, pairs % n_terms, counts


def _score_block(w: QueryWeights, field: int, shared, n_docs: int, doc, term, tf, dl, k1: float, b: float) -> np.ndarray:
    """Scores [document, query] of one field; ``shared`` are its ``shared_terms``."""
    columns, matrix = shared
    part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[doc] / w.avgdl[field]))
    n, width = len(w.query_ids), len(matrix)
    column = columns[term]
    often, seldom = np.flatnonzero(column >= 0), np.flatnonzero(column < 0)
    dense = np.bincount(doc[often] * width + column[often], weights=part[often], minlength=n_docs * width)
    sums = dense.reshape(n_docs, width) @ matrix
    # A hit of any other term meets the queries of its term.
    doc, part, row = doc[seldom], part[seldom], field * len(w.terms) + term[seldom]
    fan = w.starts[row + 1] - w.starts[row]
    offset = np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan)
    entry = np.repeat(w.starts[row], fan) + offset
    flat = np.repeat(doc, fan) * n + w.queries[entry]
    sums += np.bincount(flat, weights=np.repeat(part, fan) * w.weights[entry], minlength=n_docs * n).reshape(n_docs, n)
    return np.round(sums, SCORE_DIGITS)


def _ids(column) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


def scored_locally(docs: DataFrame, weights: QueryWeights, query_type, k: int, k1: float = K1, b: float = B):
    """Each task's top ``k`` per (query, field) of ``docs(field, doc_id, dl, terms[, tfs])`` or ``docs(field, doc_id, line)``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(weights)
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"query_id {query_type.simpleString()}, field string, doc_id {doc_type}, score double"
    counted, lined = "tfs" in docs.columns, "line" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        n = len(w.query_ids)
        keepers = [TopKeeper(n, k) for _ in w.fields]
        frequent = [w.shared_terms(f) for f in range(len(w.fields))]
        step = max(1, PAIRS_IN_MEMORY // max(n, SHARED_TERMS))
        for batch in batches:
            codes = pc.index_in(batch.column("field"), pa.array(w.fields, pa.string()))
            for f, keeper in enumerate(keepers):
                mine = batch.filter(pc.fill_null(pc.equal(codes, f), False))
                for start in range(0, mine.num_rows, step):
                    block = mine.slice(start, step)
                    lists = token_lists(block.column("line")) if lined else block.column("terms")
                    found = pc.index_in(lists.flatten(), w.terms)
                    hit = pc.is_valid(found).to_numpy(zero_copy_only=False)
                    doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)[hit].astype(np.int64)
                    term = found.to_numpy(zero_copy_only=False)[hit].astype(np.int64)
                    if not len(doc):
                        continue
                    tf = block.column("tfs").flatten().to_numpy(zero_copy_only=False)[hit] if counted else None
                    lengths = pc.fill_null(pc.list_value_length(lists), 0) if lined else block.column("dl")
                    dl = lengths.to_numpy(zero_copy_only=False)
                    doc, term, tf = _term_counts(doc, term, tf, len(w.terms))
                    scores = _score_block(w, f, frequent[f], block.num_rows, doc, term, tf, dl, k1, b)
                    keeper.add(_ids(block.column("doc_id")), scores, scores > 0)
        for f, keeper in enumerate(keepers):
            queries, ids, scores = keeper.result()
            if len(queries):
                names = pa.array([w.fields[f]] * len(queries), pa.string())
                found_ids = pa.array([w.query_ids[q] for q in queries])
                yield pa.RecordBatch.from_arrays(
                    [found_ids, names, pa.array(ids), pa.array(scores)], ["query_id", "field", "doc_id", "score"]
                )

    return docs.mapInArrow(run, schema)


def search_fields(rows: DataFrame, queries: DataFrame, k: int | dict[str, int] = 50, tokenizer=tokens,
                  stats: CorpusStats | None = None, lined: bool = False, **params) -> DataFrame:
    """Top ``k`` per (query, field) among positive scores, best first; ``stats`` are those of the rows if known.

    ``lined`` says that the rows' text is a ``token_line`` already.
    """
    qterms = query_terms(queries, tokenizer)
    toks = tokenised(rows, line_tokens if lined else tokenizer)
    small = few_terms(qterms)
    wterms = weighted_terms(qterms, stats or corpus_stats(toks), small)
    if not small:
        hits = hits_from_text(toks, qterms, small)
        return best_per_field(score_hits(hits, wterms, small, **params), k)
    limit = k if isinstance(k, int) else max(k.values())
    query_type = queries.schema["query_id"].dataType
    if tokenizer is tokens:
        line = F.col("text") if lined else token_line(F.col("text"))
        toks = rows.select("field", "doc_id", line.alias("line"))
    return best_per_field(scored_locally(toks, QueryWeights.collect(wterms), query_type, limit, **params), k)


def best_per_field(scores: DataFrame, k: int | dict[str, int]) -> DataFrame:
    limit = k if isinstance(k, int) else max(k.values())
    ranked = top_k(
        scores.filter("score > 0"), ["query_id", "field"], [F.desc("score"), F.asc("doc_id")], limit
    )
    if isinstance(k, dict):
        cut = F.coalesce(*[F.when(F.col("field") == f, F.lit(n)) for f, n in k.items()], F.lit(limit))
        ranked = ranked.filter(F.col("rank") <= cut)
    return ranked


def first_field_wins(ranked: DataFrame, order: tuple[str, ...] = ("keywords", "summary", "content"),
                     k: int = 10) -> DataFrame:
    """Multi-field result: the first field (in ``order``) that found a document keeps it."""
    priority = F.array_position(F.array(*[F.lit(f) for f in order]), F.col("field"))
    kept = top_k(
        ranked.withColumn("_p", priority), ["query_id", "doc_id"], [F.asc("_p"), F.asc("rank")], 1, "_first"
    )
    return top_k(
        kept.drop("_first", "rank"), ["query_id"], [F.desc("score"), F.asc("_p"), F.asc("doc_id")], k
    ).drop("_p")


# ----------------------------------------------------------------- saved index


@dataclass(frozen=True)
class SavedIndex:
    postings: DataFrame
    stats: CorpusStats


def write_index(rows: DataFrame, path: str, tokenizer=tokens) -> None:
    """Write postings and statistics.

    Postings are range partitioned by (field, term, doc_id): a term found in a
    third of all documents is spread over many files, and the sort lets a query
    skip the row groups of terms it does not name.
    """
    toks = tokenised(rows, tokenizer)
    postings = (
        toks.select("field", "doc_id", "dl", F.explode_outer("terms").alias("term"))
        .filter("term is not null")
        .groupBy("field", "doc_id", "dl", "term")
        .agg(F.count("*").alias("tf"))
    )
    (
        postings.repartitionByRange("field", "term", "doc_id")
        .sortWithinPartitions("field", "term", "doc_id")
        .write.mode("overwrite").parquet(f"{path}/postings")
    )
    stats = corpus_stats(toks)
    (
        stats.terms.repartitionByRange("field", "term").sortWithinPartitions("field", "term")
        .write.mode("overwrite").parquet(f"{path}/terms")
    )
    stats.fields.write.mode("overwrite").parquet(f"{path}/fields")


def read_index(spark: SparkSession, path: str) -> SavedIndex:
    read = spark.read.parquet
    return SavedIndex(read(f"{path}/postings"), CorpusStats(read(f"{path}/fields"), read(f"{path}/terms")))


def hits_from_index(index: SavedIndex, qterms: DataFrame, prune_terms: int = 1000) -> DataFrame:
    """Postings of the query terms; a short term list is pushed into the scan."""
    wanted = qterms.select("term").distinct()
    short = [r.term for r in wanted.limit(prune_terms + 1).collect()]
    hits = index.postings
    if len(short) <= prune_terms:
        hits = hits.filter(F.col("term").isin(short))
    else:
        hits = hits.join(_hinted(wanted, few_terms(qterms)), "term", "left_semi")
    return hits.repartition("field", "doc_id")


def search_index(index: SavedIndex, queries: DataFrame, k: int = 50, tokenizer=tokens) -> DataFrame:
    qterms = query_terms(queries, tokenizer)
    small = few_terms(qterms)
    wterms = weighted_terms(qterms, index.stats, small)
    hits = hits_from_index(index, qterms)
    if not small:
        return best_per_field(score_hits(hits, wterms, small), k)
    # Back to one row per document; only its postings of query terms are gathered.
    docs = hits.groupBy("field", "doc_id", "dl").agg(
        F.collect_list(F.struct("term", "tf")).alias("h")
    ).select("field", "doc_id", "dl", F.col("h.term").alias("terms"), F.col("h.tf").alias("tfs"))
    query_type = queries.schema["query_id"].dataType
    return best_per_field(scored_locally(docs, QueryWeights.collect(wterms), query_type, k), k)
