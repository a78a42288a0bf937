"""Fuzzy duplicate lines: MinHash over character shingles, one line kept per component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusweir.llm.mixing import renewed
from corpusweir.llm.nearsets import Similarity, linked
from corpusweir.llm.shingling import MinHash, chunks, line_shingles
from corpusweir.session import bounded_broadcast, written_table

#: 12 bands of 4 minima: lines at the threshold of 0.8 meet in one with probability 0.998, at 0.85 with 0.9999.
LINES = Similarity("chars", k=5, hashes=64, rows=4, bands=12)

#: Seed of Spark's xxhash64, so that lines hashed here and there agree.
SPARK_SEED = 42
#: Lines hashed together, hashes a task remembers to sign a repeated line once, and places for band keys (8 bytes each).
LINE_BATCH, REMEMBERED, PLACES = 4096, 300_000, 1 << 20
#: Hashes of candidate lines that may be broadcast (8 bytes each); beyond it their texts are found by a shuffle.
CANDIDATES = 1_000_000

SIGNED = "th bigint, line_no int, h bigint, keys array<bigint>, again array<bigint>, sketch array<bigint>"


def signed_lines(docs: DataFrame, similarity: Similarity) -> DataFrame:
    """``docs(_id, th, text)`` as one row per line that is not blank.

    A line that a task has met before has no sketch and no keys; its first row there has
    them.  ``keys`` holds the band keys that are new to the task, ``again`` the others, so a
    key that very many lines share reaches the shuffle about once per task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(similarity.hashes, similarity.seed)
        met: set[int] = set()
        # The last key of each place; one that another has driven out is taken for new once more.
        used = np.zeros(PLACES, np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            # Lines of at most so many code points, or of one longer text, are held at a time.
            for begin, end in chunks(texts):
                row, number, line = [], [], []
                for i in range(begin, end):
                    for k, part in enumerate(texts[i].split("\n")):
                        if part and not part.isspace():
                            row.append(i)
                            number.append(k)
                            line.append(part)
                for a in range(0, len(line), LINE_BATCH):
                    part = line[a : a + LINE_BATCH]
                    h = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), SPARK_SEED) for x in part], np.uint64)
                    h = h.view(np.int64)
                    new = []
                    for i, x in enumerate(h.tolist()):
                        if x not in met:
                            met.add(x)
                            new.append(i)
                    if len(met) > REMEMBERED:
                        met.clear()
                    shingles, offsets = line_shingles([part[i] for i in new], similarity.k)
                    minima = minhash.minima_of(shingles, offsets)
                    keys = similarity.keys(minima)
                    flat = keys.ravel()
                    at = flat & np.int64(PLACES - 1)
                    fresh = np.zeros(keys.shape, bool)
                    fresh.ravel()[np.unique(flat, return_index=True)[1]] = True
                    fresh &= (used[at] != flat).reshape(keys.shape)
                    used[at] = flat
                    lists = []
                    for values, there in ((keys, fresh), (keys, ~fresh), (sketch := similarity.sketch(minima), np.ones(sketch.shape, bool))):
                        counts = np.zeros(len(part), np.int64)
                        counts[new] = there.sum(axis=1)
                        at = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                        lists.append(pa.ListArray.from_arrays(pa.array(at), pa.array(values[there])))
                    taken = batch.select([0, 1]).take(pa.array(row[a : a + LINE_BATCH], pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [taken.column(0), taken.column(1), pa.array(number[a : a + LINE_BATCH], pa.int32()), pa.array(h), *lists],
                        ["_id", "th", "line_no", "h", "keys", "again", "sketch"],
                    )

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.select("_id", "th", "text").mapInArrow(run, f"_id {kind}, {SIGNED}")


def duplicate_lines(
    docs: DataFrame, similarity: Similarity = LINES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per line that is not blank: ``id_col``, line_no (from 0), first_id, first_line, kept, text_hash.

    Lines are what line feeds part.  Lines of a similarity of 0.8 or more, directly or
    through others, are a component; its first line, by id, then line number, is kept and
    named in the rows of all.  Equal lines are one item, whatever their number.  Lines
    shorter than a shingle have one, the whole line.  Null and empty texts have no lines;
    null ids come after all others; rows that agree in id and text are treated alike.
    Other columns are not read.
    """
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    lines = written_table(signed_lines(narrow, similarity))
    # Band rows of keys that are not alone: those met again in a task, and those of several lines.
    again = written_table(lines.select(F.explode("again").alias("key"), F.col("h").alias("id")).distinct())
    fresh = lines.select(F.explode("keys").alias("key"), F.col("h").alias("id"), F.lit(0).alias("_met"))
    marks = again.select("key").distinct().select("key", F.lit(None).cast("long").alias("id"), F.lit(1).alias("_met"))
    together = Window.partitionBy("key")
    low, high, met = F.min("id").over(together), F.max("id").over(together), F.max("_met").over(together)
    several = fresh.union(marks).select("key", "id", ((low < high) | (met == 1)).alias("_keep")).filter("_keep and id is not null")
    rows = written_table(several.select("key", "id").union(again).distinct())
    signed = lines.filter(F.size("sketch") > 0).select(F.col("h").alias("id"), "sketch")
    items = written_table(
        signed.join(rows.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]).select("id", F.lit(0).cast("long").alias("n"), "sketch")
    )

    def texts_of(ids: DataFrame) -> DataFrame:
        split = narrow.select(F.explode(F.split("text", "\n")).alias("text"))
        hashed = split.withColumn("id", F.xxhash64("text"))
        met = hashed.join(bounded_broadcast(written_table(ids), CANDIDATES), "id", "left_semi")
        return met.groupBy("id").agg(F.first("text").alias("text"))

    roots = written_table(linked(items, texts_of, similarity, rows))
    named = lines.select("_id", "th", "line_no", "h").join(roots.withColumnRenamed("id", "h"), "h", "left").select(
        "_id", "th", "line_no", F.coalesce("root", "h").alias("root")
    )
    here = F.struct(F.isnull("_id").alias("x"), "_id", "line_no", "th")
    first = named.groupBy("root").agg(F.min(here).alias("_first"))
    return named.join(first, "root").select(
        F.col("_id").alias(id_col),
        "line_no",
        F.col("_first._id").alias("first_id"),
        F.col("_first.line_no").alias("first_line"),
        (here == F.col("_first")).alias("kept"),
        F.col("th").alias("text_hash"),
    )


def without_duplicate_lines(docs: DataFrame, similarity: Similarity = LINES, **cols) -> DataFrame:
    """The rows of ``docs`` with the kept and the blank lines only, in the same columns.

    A document that loses its last line goes; one that had none stays as it is.  ``n_chars``,
    where there is such a column, follows the text.
    """
    id_col, text_col = cols.get("id_col", "doc_id"), cols.get("text_col", "text")
    marks = duplicate_lines(docs, similarity, **cols)
    lost = marks.filter(~F.col("kept")).groupBy(F.col(id_col).alias("_gid"), F.col("text_hash").alias("_gth")).agg(
        F.collect_set("line_no").alias("_lost")
    )
    hashed = docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    )
    met = hashed.join(lost, F.col("_id").eqNullSafe(F.col("_gid")) & (F.col("_hash") == F.col("_gth")), "left")
    before = F.col("row").getField(text_col)
    parts = F.split(before, "\n")
    stays = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_lost"))
    left = F.array_join(F.transform(stays, lambda i: F.get(parts, i)), "\n")
    changed = F.col("_lost").isNotNull()
    out = met.withColumn("_left", F.when(changed, left).otherwise(before)).filter(~changed | F.col("_left").rlike(r"\S"))
    return out.select(*renewed(docs, text_col, F.col("_left"), changed))
