"""MinHash near-duplicate documents with b-bit sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweir.llm.nearsets import Similarity, linked
from corpusweir.llm.shingling import chunks, word_shingles, words
from corpusweir.session import written_table

#: 32 bands of 4 minima: a pair at the threshold of 0.8 shares no band once in 20 million.
WORD_PAIRS = Similarity("words", k=2, hashes=128, rows=4)
FIVE_WORDS = Similarity("words", k=5, hashes=128, rows=4)

SIGNED = "rid bigint, th bigint, n bigint, f1 bigint, f2 bigint, keys array<bigint>, sketch array<bigint>"


def signatures(docs: DataFrame, similarity: Similarity) -> DataFrame:
    """``docs(_id, rid, th, text)`` with the fingerprint of its set, band keys and sketch.

    Equal sets have equal 128-bit fingerprints.  Empty sets have no keys.
    """

    def lists(rows: np.ndarray, some: list[bool]) -> pa.Array:
        return pa.array([r if s else [] for r, s in zip(rows, some, strict=True)], pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in batch.column(3).to_pylist()]
            for a, b in chunks(texts):
                hashes, _, _, offsets = words(texts[a:b])
                shingles, out = word_shingles(hashes, offsets, similarity.k)
                sets = [np.unique(shingles[out[i] : out[i + 1]]) for i in range(b - a)]
                minima = similarity.minima(sets)
                prints = b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets)
                f = np.frombuffer(prints, np.int64).reshape(-1, 2)
                n = [len(s) for s in sets]
                some = [x > 0 for x in n]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), part.column(2), pa.array(n, pa.int64()), pa.array(f[:, 0]),
                        pa.array(f[:, 1]), lists(similarity.keys(minima), some), lists(similarity.sketch(minima), some),
                    ],
                    ["_id", "rid", "th", "n", "f1", "f2", "keys", "sketch"],
                )

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.select("_id", "rid", "th", "text").mapInArrow(run, f"_id {kind}, {SIGNED}")


def near_duplicates(
    docs: DataFrame, similarity: Similarity = FIVE_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_shingles, component_id, kept, first_copy, text_hash.

    ``component_id`` is the smallest id of all documents linked with this one, directly or
    through others, its own included.  ``kept`` is true where that is its own id;
    ``first_copy`` on just one row of every component, also when rows repeat.  Null and
    empty texts, and texts of white space, have no shingles and are linked with nothing.
    Null ids take part but are never the smallest unless all are null.  Other columns are not read.
    """
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    numbered = narrow.withColumn("rid", F.monotonically_increasing_id())
    signed = written_table(signatures(numbered, similarity))
    # A class is a set; its smallest row stands for all of them.
    classes = written_table(
        signed.filter("n > 0").groupBy("f1", "f2", "n").agg(
            F.min("rid").alias("rep"), F.min("_id").alias("_least"), F.min(F.struct(F.isnull("_id").alias("x"), "_id", "rid")).alias("_first")
        )
    )
    items = written_table(
        signed.join(classes.select(F.col("rep").alias("rid")), "rid").select(
            F.col("rid").alias("id"), F.col("_id").alias("_did"), "th", "n", "keys", "sketch"
        )
    )

    def texts_of(ids: DataFrame) -> DataFrame:
        wanted = items.select("id", "_did", "th").join(ids, "id")
        met = wanted.join(narrow, wanted["_did"].eqNullSafe(narrow["_id"]) & (wanted["th"] == narrow["th"]))
        return met.select(wanted["id"], narrow["text"])

    roots = linked(items, texts_of, similarity)
    comp = classes.join(roots.withColumnRenamed("id", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    whole = comp.groupBy("root").agg(F.min("_least").alias("_comp"), F.min("_first").alias("_head"))
    named = comp.join(whole, "root").select("f1", "f2", "n", "_comp", F.col("_head.rid").alias("_head"))
    out = signed.select("_id", "rid", "th", "n", "f1", "f2").join(named, ["f1", "f2", "n"], "left")
    alone = F.col("n") == 0
    component = F.when(alone, F.col("_id")).otherwise(F.col("_comp"))
    return out.select(
        F.col("_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("_id").eqNullSafe(component).alias("kept"),
        F.when(alone, F.lit(True)).otherwise(F.col("rid") == F.col("_head")).alias("first_copy"),
        F.col("th").alias("text_hash"),
    )


def without_near_duplicates(docs: DataFrame, similarity: Similarity = FIVE_WORDS, **cols) -> DataFrame:
    """The rows of ``docs`` without all but one of each component, in the same columns.

    Rows are found again by id and text hash; of rows that agree in both, one stays if the
    text has words, and all if it has none.
    """
    id_col, text_col = cols.get("id_col", "doc_id"), cols.get("text_col", "text")
    marks = near_duplicates(docs, similarity, **cols)
    keep = marks.filter(F.col("first_copy") & (F.col("n_shingles") > 0)).select(
        F.col(id_col).alias("_kid"), F.col("text_hash").alias("_kth")
    )
    has_words = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    worded, rest = docs.filter(has_words), docs.filter(~has_words)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hashed = worded.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.struct(*columns).alias("_row"))
    chosen = hashed.join(keep, F.col("_id").eqNullSafe(F.col("_kid")) & (F.col("_hash") == F.col("_kth")), "left_semi")
    once = chosen.dropDuplicates(["_id", "_hash"])
    return once.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns]).unionByName(rest)
