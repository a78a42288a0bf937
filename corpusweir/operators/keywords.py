"""Keyword lists and their views."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusweir.functions.text import token_lists


def top_scored(keywords: Column, scores: Column, n: int = 5) -> Column:
    """First ``n`` (keyword, score) by score; equal scores keep their order."""
    zipped = F.zip_with(
        F.transform(keywords, lambda k, i: F.struct(i.alias("i"), k.alias("k"))), scores,
        lambda k, s: F.struct((-s).alias("o"), k["i"].alias("i"), k["k"].alias("keyword"), s.alias("score")),
    )
    cut = F.slice(F.array_sort(zipped), 1, n)
    return F.transform(cut, lambda z: F.struct(z["keyword"].alias("keyword"), z["score"].alias("score")))


def in_category(keywords: Column, category: str) -> Column:
    """Keywords of one category from an array of (keyword, score, category)."""
    return F.filter(keywords, lambda k: k["category"] == category)


def _ranked(lists: pa.Array, n: int | None, shortest: int = 0) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count, first position, rank) of the ``n`` most frequent terms of every list, in this order."""
    terms = lists.flatten().dictionary_encode()
    row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    counted = terms.indices.is_valid().to_numpy(zero_copy_only=False)
    if shortest:
        long = pc.greater_equal(pc.utf8_length(terms.dictionary), shortest)
        counted = pc.fill_null(long.take(terms.indices), False).to_numpy(zero_copy_only=False)
    there = np.flatnonzero(counted)
    if not len(there):
        none = np.zeros(0, np.int64)
        return none, pa.array([], pa.string()), none, none, none
    known = len(terms.dictionary)
    code = row[there] * known + terms.indices.take(pa.array(there)).to_numpy(zero_copy_only=False)
    codes, at, count = _runs(code, there, (int(row[-1]) + 1) * known)
    of, first = codes // known, at - np.searchsorted(row, codes // known)
    order = _best_first(of, count, first)
    rank = np.arange(len(order)) - np.searchsorted(of, of) + 1
    kept = np.flatnonzero(rank <= (n or len(rank)))
    order, rank = order[kept], rank[kept]
    return of[order], terms.dictionary.take(pa.array(codes[order] % known)), count[order], first[order], rank


def _best_first(of: np.ndarray, count: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions by row, then most frequent, then first place, which no two terms of a row share."""
    most, places = int(count.max()), int(first.max()) + 1
    if (int(of.max()) + 1) * (most + 1) * places >= 2**63:
        return np.lexsort((first, -count, of))
    return np.argsort((of * (most + 1) + most - count) * places + first)


def _runs(code: np.ndarray, place: np.ndarray, n_codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, first place, count) of the distinct codes; places ascend."""
    places = int(place[-1]) + 1
    if n_codes * places >= 2**63:
        codes, at, count = np.unique(code, return_index=True, return_counts=True)
        return codes, place[at], count
    # Code and place in one number, which sorts several times as fast as an index of the codes.
    codes, at = np.divmod(np.sort(code * places + place), places)
    starts = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[starts], at[starts], np.diff(np.append(starts, len(codes)))


def frequent_terms(tokenised: DataFrame, keys: list[str], n: int | None = 10) -> DataFrame:
    """Most frequent terms per row, all with ``n=None``; the first occurrence breaks ties.

    ``tokenised`` has the keys and an array column ``terms``, one row per key.  Terms are
    counted inside the row, a batch of rows at a time; nothing is shuffled.  A row whose
    terms are null or empty gives none, nor do null terms.
    """
    rows = tokenised.select(*keys, "terms")
    schema = T.StructType([
        *rows.schema.fields[:-1], T.StructField("term", T.StringType()), T.StructField("n", T.LongType()),
        T.StructField("first_pos", T.IntegerType()), T.StructField("rank", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, terms, count, first, rank = _ranked(batch.column("terms"), n)
            if len(of):
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(k).take(pa.array(of)) for k in keys], terms,
                    pa.array(count.astype(np.int64)), pa.array(first.astype(np.int32)), pa.array(rank.astype(np.int64)),
                ], schema.names)

    return rows.mapInArrow(run, schema)


def with_frequent_terms(tokenised: DataFrame, n: int, out: str = "keywords", shortest: int = 1) -> DataFrame:
    """Replace ``line`` (a ``token_line``) by the list ``out`` of the ``n`` most frequent of its terms of ``shortest``
    characters and more, ranked as in ``frequent_terms``; rows stay where they are."""
    kept = [c for c in tokenised.columns if c != "line"]
    rows = tokenised.select(*kept, "line")
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(out, T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, terms, *_ = _ranked(token_lists(batch.column("line")), n, shortest)
            starts = np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(starts), terms)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], lists], schema.names)

    return rows.mapInArrow(run, schema)
