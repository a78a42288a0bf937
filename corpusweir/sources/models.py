"""Remote models behind Arrow batches, and offline stand-ins.

A client is made once per task by ``make_client`` and called with bounded
batches; Spark's partitioning gives the concurrency.  A failed call is retried by
the caller's client; what still fails is an error of the task, not an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusweir.functions.text import token_line, token_lists

EMBED_BATCH, RERANK_BATCH = 10, 32

Embed = Callable[[list[str]], list[list[float]]]
Rerank = Callable[[str, list[str]], list[tuple[int, float]]]
Generate = Callable[[list[str]], list[str]]


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def _in_batches(values: list, size: int) -> Iterator[list]:
    for start in range(0, len(values), size):
        yield values[start:start + size]


def embed(df: DataFrame, text: str, make_client: Callable[[], Embed], out: str = "embedding",
          batch: int = EMBED_BATCH) -> DataFrame:
    """Add an embedding per row; an empty text gets an empty embedding."""
    schema = _with(df, out, T.ArrayType(T.FloatType()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for pdf in batches:
            texts = pdf[text].fillna("").tolist()
            filled = [t for t in texts if t]
            vectors = iter([v for part in _in_batches(filled, batch) for v in client(part)])
            yield pdf.assign(**{out: [next(vectors) if t else [] for t in texts]})

    return df.mapInPandas(run, schema)


def rerank_scores(candidates: DataFrame, make_client: Callable[[], Rerank], batch: int = RERANK_BATCH) -> DataFrame:
    """(query_id, doc_id, rerank_score) from a model that answers (index, score) pairs.

    ``candidates(query_id, query, doc_id, content)`` are top-k lists, so one
    query's documents fit a group; blank documents are left out.
    """
    kept = candidates.filter(F.length(F.trim(F.coalesce("content", F.lit("")))) > 0)
    types = dict(candidates.dtypes)
    schema = f"query_id {types['query_id']}, doc_id {types['doc_id']}, rerank_score double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        client, rows = make_client(), []
        for start in range(0, len(pdf), batch):
            part = pdf.iloc[start:start + batch]
            for index, score in client(part["query"].iloc[0], part["content"].tolist()):
                rows.append((part["query_id"].iloc[index], part["doc_id"].iloc[index], float(score)))
        return pd.DataFrame(rows, columns=["query_id", "doc_id", "rerank_score"])

    return kept.groupBy("query_id").applyInPandas(run, schema)


def generate(df: DataFrame, prompt: str, make_client: Callable[[], Generate], out: str = "response",
             batch: int = EMBED_BATCH) -> DataFrame:
    schema = _with(df, out, T.StringType())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for pdf in batches:
            yield pdf.assign(**{out: [r for part in _in_batches(pdf[prompt].tolist(), batch) for r in client(part)]})

    return df.mapInPandas(run, schema)


# ------------------------------------------------------------ offline stand-ins


def hashed_embedder(size: int = 64) -> Callable[[], Embed]:
    """Unit vectors of hashed word counts: repeatable, needs no service."""
    def client(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.bincount([crc32(w.encode()) % size for w in t.lower().split()] or [0], minlength=size).astype(float)
            out.append((v / np.linalg.norm(v)).tolist())
        return out

    return lambda: client


HASHED_SIZE = 64


def _digest_heads(terms: pa.StringArray) -> np.ndarray:
    """The first five hexadecimal digits of every term's md5, as numbers."""
    if not len(terms):
        return np.zeros(0, np.int64)
    _, ends, data = terms.buffers()
    ends, data = np.frombuffer(ends, np.int32)[terms.offset:][:len(terms) + 1].tolist(), data.to_pybytes()
    digests = b"".join([md5(data[i:j]).digest() for i, j in zip(ends, ends[1:])])
    heads = np.frombuffer(digests, np.uint8).reshape(-1, 16)[:, :3].astype(np.int64)
    return heads[:, 0] << 12 | heads[:, 1] << 4 | heads[:, 2] >> 4


def hashed_vectors(df: DataFrame, text: str, out: str = "embedding", lined: bool = False) -> DataFrame:
    """Add signed counts of the text's tokens in 64 places, chosen by md5; null without tokens.

    ``lined`` says that the text is a ``token_line`` already.
    """
    kept = df.columns
    schema = _with(df, out, T.ArrayType(T.FloatType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = token_lists(batch.column("_line"))
            terms = lists.flatten().dictionary_encode()
            heads = _digest_heads(terms.dictionary)
            place, sign = (heads >> 4) % HASHED_SIZE, 1 - 2 * (heads % 2)
            row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            at = terms.indices.to_numpy(zero_copy_only=False)
            sums = np.zeros(batch.num_rows * HASHED_SIZE)
            if len(at):
                sums = np.bincount(row * HASHED_SIZE + place[at], weights=sign[at], minlength=len(sums))
            sums = sums.reshape(-1, HASHED_SIZE).astype(np.float32)
            filled = sums.any(axis=1)
            ends = np.concatenate([[0], np.cumsum(filled * HASHED_SIZE)]).astype(np.int32)
            vectors = pa.ListArray.from_arrays(pa.array(ends), pa.array(sums[filled].ravel()), mask=pa.array(~filled))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], vectors], [*kept, out])

    return df.withColumn("_line", F.col(text) if lined else token_line(F.col(text))).mapInArrow(run, schema)


# Topics a stand-in answer is chosen by (fixed values), first match wins.
TOPICS = (
    ("hypertension", ("高血压",)), ("diabetes", ("糖尿病",)), ("heart", ("心脏病", "心脏")),
    ("cancer", ("癌症", "肿瘤")), ("cold", ("感冒", "发烧")),
)


def canned_response(prompt: Column, answers: dict[str, str], default: str) -> Column:
    """Answer by the first topic word in the prompt."""
    out = F.when(F.lit(False), "")
    for topic, words in TOPICS:
        for word in words:
            out = out.when(prompt.contains(word), answers.get(topic, default))
    return out.otherwise(default)
