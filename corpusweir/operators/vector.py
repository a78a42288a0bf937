"""Exact cosine top-k for a batch of query vectors.

No query/vector pair is ever emitted: a task multiplies a block of vectors with
the query matrix and keeps ``k`` candidates per query, so the shuffle carries
``k`` rows per query and task.  A query set beyond ``QUERY_BLOCK`` is cut into
blocks which are co-grouped with blocks of the vectors, so neither side has to fit
into one task or the driver.  ``vector_index`` stores vectors for repeated searches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweir.operators.topk import SCORE_DIGITS, top_k
from corpusweir.operators.topkeeper import TopKeeper

QUERY_BLOCK, VECTOR_BLOCK = 4096, 65_536


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns in double precision; 0 for a zero vector."""
    da, db = a.cast("array<double>"), b.cast("array<double>")

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(da, da)) * F.sqrt(dot(db, db))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(da, db) / F.nullif(norm, F.lit(0.0)))


def clipped_cosine(a: Column, b: Column) -> Column:
    """Similarity in [0, 1]; a missing side scores 0."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(a, b))), F.lit(0.0))


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _score(keeper: TopKeeper, qids: np.ndarray, qmat: np.ndarray, ids: np.ndarray, vmat: np.ndarray,
           exclude_self: bool) -> None:
    scores = np.round(_unit(vmat) @ qmat.T, SCORE_DIGITS)
    keeper.add(ids, scores, ids[:, None] != qids[None, :] if exclude_self else None)


def _emit(keeper: TopKeeper, qids: np.ndarray) -> pd.DataFrame:
    queries, ids, scores = keeper.result()
    return pd.DataFrame({"query_id": qids[queries], "doc_id": ids, "score": scores})


def _ids(values: np.ndarray) -> np.ndarray:
    return values.astype(str) if values.dtype == object else values


def _schema(vectors: DataFrame, queries: DataFrame) -> str:
    return f"query_id {dict(queries.dtypes)['query_id']}, doc_id {dict(vectors.dtypes)['doc_id']}, score double"


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, min_score: float | None = None,
                exclude_self: bool = False, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``vectors(doc_id, embedding)`` x ``queries(query_id, embedding)`` -> ranked hits.

    Filter ``vectors`` beforehand for a metadata condition: it reaches the scan.
    """
    vectors = vectors.select("doc_id", "embedding").filter("embedding is not null")
    queries = queries.select("query_id", "embedding").filter("embedding is not null")
    head = queries.limit(query_block + 1).toPandas()
    if len(head) <= query_block:
        local = _small_query_set(vectors, head, k, exclude_self, _schema(vectors, queries))
    else:
        local = _blocked(vectors, queries, k, exclude_self, query_block)
    if min_score is not None:
        local = local.filter(F.col("score") >= min_score)
    return top_k(local, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)


def _small_query_set(vectors: DataFrame, head: pd.DataFrame, k: int, exclude_self: bool, schema: str) -> DataFrame:
    spark = vectors.sparkSession
    if head.empty:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(
        (_ids(head["query_id"].to_numpy()), _unit(_matrix(head["embedding"])))
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, qmat = shared.value
        keeper = TopKeeper(len(qids), k)
        for batch in batches:
            if batch.num_rows:
                lengths = pc.unique(pc.list_value_length(batch.column("embedding"))).to_pylist()
                if lengths != [qmat.shape[1]]:
                    raise ValueError(f"vectors of length {lengths} against queries of length {qmat.shape[1]}")
                flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                _score(keeper, qids, qmat, _ids(batch.column("doc_id").to_numpy(zero_copy_only=False)), flat.reshape(batch.num_rows, -1), exclude_self)
        yield pa.RecordBatch.from_pandas(_emit(keeper, qids), preserve_index=False)

    return vectors.mapInArrow(scan, schema)


def _blocked(vectors: DataFrame, queries: DataFrame, k: int, exclude_self: bool, block: int) -> DataFrame:
    n_blocks = -(-queries.count() // block)
    buckets = max(1, -(-vectors.count() // VECTOR_BLOCK))
    left = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))).withColumn(
        "vb", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))
    )
    right = vectors.withColumn("vb", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")).withColumn(
        "qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))
    )

    def multiply(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        qids = _ids(q["query_id"].to_numpy())
        keeper = TopKeeper(len(qids), k)
        if len(q) and len(v):
            qmat = _unit(_matrix(q["embedding"]))
            for start in range(0, len(v), 8192):
                part = v.iloc[start:start + 8192]
                _score(keeper, qids, qmat, _ids(part["doc_id"].to_numpy()), _matrix(part["embedding"]), exclude_self)
        return _emit(keeper, qids)

    return left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(multiply, _schema(vectors, queries))


def most_similar(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """The single most similar candidate; -1 for a query without any candidate."""
    best = vector_topk(vectors, queries, 1)
    return queries.select("query_id").join(best, "query_id", "left").select(
        "query_id",
        F.coalesce("doc_id", F.lit(-1)).alias("doc_id"),
        F.coalesce(F.greatest("score", F.lit(0.0)), F.lit(0.0)).alias("score"),
    )
