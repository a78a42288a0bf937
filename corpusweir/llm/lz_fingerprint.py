"""Lempel-Ziv phrase fingerprints.

A text is parsed into the phrases of a growing dictionary, each a known phrase and one
more character.  Texts that compress well together share phrases; the minimum hashes of
the phrase set estimate that share without either text.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from corpusweir.llm.shingling import MinHash, mixed, run_hashes
from corpusweir.session import shuffle_partitions, written_table

MINIMA = 128


class Parse:
    """The dictionary, the place in it and the ends of the phrases so far."""

    def __init__(self) -> None:
        self.known: dict[int, int] = {}
        self.node = 0
        self.ends: list[int] = []
        self.at = 0

    def copy(self) -> Parse:
        other = Parse()
        other.known, other.node, other.ends, other.at = self.known.copy(), self.node, self.ends.copy(), self.at
        return other

    def feed(self, codes: list[int]) -> Parse:
        known, node, ends, i = self.known, self.node, self.ends, self.at
        get = known.get
        for c in codes:
            i += 1
            key = node << 21 | c
            node = get(key, 0)
            if not node:
                known[key] = len(known) + 1
                ends.append(i)
        self.node, self.at = node, i
        return self

    def fingerprint(self, codes: np.ndarray, minhash: MinHash) -> np.ndarray:
        """16-bit minima over the set of phrases, the unfinished last one included."""
        ends = np.array(self.ends, np.int64)
        if self.at and (not len(ends) or ends[-1] != self.at):
            ends = np.append(ends, self.at)
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        return (mixed(minhash.minima(run_hashes(codes, starts, ends)).astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def code_array(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def as_text(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal minima: the estimated Jaccard similarity of two phrase sets."""
    return float((a == b).mean())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_chars and fingerprint of every row's whole text; null texts count as empty.

    Equal texts have equal fingerprints.  Null ids stay null, repeated rows are rows of their
    own, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(MINIMA)
        for batch in batches:
            n, prints = [], []
            for text in batch.column(1).to_pylist():
                codes = code_array(text or "")
                n.append(len(codes))
                prints.append(as_text(Parse().feed(codes.tolist()).fingerprint(codes, minhash)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(prints)], ["_id", "n_chars", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, n_chars bigint, fingerprint string").withColumnRenamed("_id", id_col)


def in_descending_order(docs: DataFrame) -> DataFrame:
    """``docs(_id, _text)`` dealt into stretches of descending ids, each sorted, with the row after it.

    The bounds come from ids and text hashes alone; the texts move once.  Rows marked
    ``_halo`` repeat the first row of the following stretch (after the last, of the first):
    one per stretch.  Null ids come last; equal ids are ordered by a hash of their text.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    rows = docs.withColumn("_th", F.xxhash64("_text"))
    order = [F.col("_id").desc_nulls_last(), F.col("_th").desc()]
    dealt = written_table(rows.select("_id", "_th").repartitionByRange(n, *order).withColumn("_seg", F.spark_partition_id()))
    key = F.struct(F.isnotnull("_id").alias("x"), "_id", "_th")
    # One row per stretch, as many as there are shuffle partitions at most.
    firsts = sorted({tuple(r[0]) for r in dealt.groupBy("_seg").agg(F.max(key).alias("k")).select("k").collect()}, key=_ranked)
    ranks = [_ranked(k) for k in firsts]

    @pandas_udf("int")
    def stretch(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        present = ids.notna()
        keys = zip(present, ids.where(present, 0), hashes, strict=True)
        return pd.Series([max(bisect_right(ranks, _ranked(k)) - 1, 0) for k in keys], dtype="int32")

    last = len(firsts) - 1
    halo = [(k[1], k[2], i - 1 if i else last) for i, k in enumerate(firsts)]
    kind = docs.schema["_id"].dataType.simpleString()
    wanted = spark.createDataFrame(halo, f"_hid {kind}, _hth bigint, _stretch int")
    extra = rows.join(F.broadcast(wanted), rows["_id"].eqNullSafe(wanted["_hid"]) & (rows["_th"] == wanted["_hth"])).select(
        "_id", "_text", "_th", "_stretch", F.lit(1).alias("_halo")
    ).dropDuplicates(["_stretch"])
    both = rows.select("_id", "_text", "_th", stretch("_id", "_th").alias("_stretch"), F.lit(0).alias("_halo")).union(extra)
    return both.repartitionByRange(n, "_stretch").sortWithinPartitions("_stretch", "_halo", *order)


def _ranked(key: tuple) -> tuple:
    """Sorts (id is present, id, hash) in descending order."""
    present, value, hashed = key
    return (not present, -value if present else 0, -hashed)


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's fingerprint beside those of an edited text and of the next row.

    The next row is that of the next smaller id (after the last, the first); the edit replaces
    the last floor(n/2) code points by the first as many, or all, of its text.  Returns
    ``id_col``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Null texts count as empty; ids are integers; null ids come last; rows of one id are ordered
    by a hash of the text.  A single row is its own next; an empty table gives an empty result.
    """
    ordered = in_descending_order(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")))
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(MINIMA)
        held = None
        for batch in batches:
            ids, texts, stretches, halos = (batch.column(c).to_pylist() for c in ("_id", "_text", "_stretch", "_halo"))
            out: list[list] = [[] for _ in names]
            for i, text in enumerate(texts):
                text = text or ""
                codes = code_array(text)
                keep = len(codes) - len(codes) // 2
                half = Parse().feed(codes[:keep].tolist())
                whole = half.copy().feed(codes[keep:].tolist()).fingerprint(codes, minhash)
                if held and held[0] == stretches[i]:
                    _, before, old, old_codes, old_keep, old_half, old_print = held
                    tail = text[: len(old) - old_keep]
                    edited = old[:old_keep] + tail
                    edited_codes = np.concatenate([old_codes[:old_keep], code_array(tail)])
                    mine = old_half.feed(code_array(tail).tolist()).fingerprint(edited_codes, minhash)
                    row = (
                        before, len(old), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_text(old_print),
                        as_text(mine), likeness(old_print, mine), likeness(old_print, whole),
                    )
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                held = None if halos[i] else (stretches[i], ids[i], text, codes, keep, half, whole)
            types = (batch.schema.field("_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    schema = f"_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
