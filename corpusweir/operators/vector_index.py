"""Vectors stored by cell, searched by probing cells or exactly.

Cells are the regions around coarse centroids, fitted on a bounded sample; every vector is
written into the folder of its nearest centroid, together with how far its cell reaches.  A
search reads only the folders its queries need.  In the exact mode a first round over the
nearest cells gives every query a score to beat; a second one reads the cells that the
triangle inequality does not rule out, so the result is that of a full scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweir.operators.topk import SCORE_DIGITS, top_k
from corpusweir.operators.topkeeper import TopKeeper
from corpusweir.session import checkpointed
from corpusweir.sources.commits import CommitLog

#: Vectors the centroids are fitted on at most, cells at most, rounds of fitting.
SAMPLE, CELLS, ROUNDS = 16_384, 4096, 12
#: Vectors and queries that one task compares at most.
ROW_BLOCK, QUERY_BLOCK = 16_384, 2048
#: What an angle may be wrong by, with much to spare.
SLACK = 1e-6


def units(column) -> np.ndarray:
    """Rows of unit length in double precision; zero vectors stay zero."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def fit_cells(x: np.ndarray, cells: int, seed: int = 0) -> np.ndarray:
    """Spherical k-means on unit rows; cells that stay empty are left out."""
    random = np.random.RandomState(seed)
    centres = x[random.permutation(len(x))[:cells]]
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1)
        centres = sums[norms > 0] / norms[norms > 0, None]
    return centres


def angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centres.T, -1, 1))


class VectorIndex:
    """Vectors ``(doc_id, embedding)`` at ``path``, all of one length; null and zero vectors are left out."""

    def __init__(self, spark: SparkSession, path: str, doc_type: str = "bigint"):
        self.log, self.doc_type = CommitLog(spark, path), doc_type

    def build(self, vectors: DataFrame, cells: int | None = None) -> VectorIndex:
        """Writes the index anew; the number of cells is the root of the number of vectors, unless given."""
        kept = vectors.select(F.col("doc_id").cast(self.doc_type), F.col("embedding").cast("array<double>")).filter(
            "embedding is not null and exists(embedding, v -> v <> 0)"
        )
        n = kept.count()
        share = min(1.0, SAMPLE / max(n, 1))
        sample = kept.filter(F.pmod(F.xxhash64("embedding"), F.lit(1_000_003)) < share * 1_000_003).limit(2 * SAMPLE).select("embedding").toArrow()
        x = units(sample.column(0)) if sample.num_rows else np.zeros((0, 1))
        wanted = cells or min(CELLS, max(1, int(n**0.5)))
        centres = fit_cells(x, min(wanted, len(x))) if len(x) else np.zeros((1, 1))
        shared = self.log.spark.sparkContext.broadcast(centres)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    gap = angles(units(batch.column(1)), shared.value)
                    cell = gap.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(gap[np.arange(len(cell)), cell])],
                        ["doc_id", "embedding", "cell", "gap"],
                    )

        placed = kept.mapInArrow(place, f"doc_id {self.doc_type}, embedding array<double>, cell int, gap double")
        part = self.log.new_part()
        # A cell that holds much is dealt over several tasks and files.
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-n // (ROW_BLOCK * 16)))))
        placed.repartition("cell", salt).write.partitionBy("cell").parquet(f"{self.log.path}/{part}")
        reach = self._read(part).groupBy("cell").agg(F.max("gap").alias("reach"), F.count("*").alias("n"))
        described = self.log.write(reach.coalesce(1))
        centre_part = self.log.write(self.log.spark.createDataFrame(
            [(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1))
        self.log.commit(lambda base: {"vectors": part, "cells": described, "centres": centre_part})
        return self

    def _read(self, part: str) -> DataFrame:
        return self.log.spark.read.schema(f"doc_id {self.doc_type}, embedding array<double>, gap double, cell int").parquet(f"{self.log.path}/{part}")

    def search(self, queries: DataFrame, k: int, probes: int = 8, exact: bool = True, min_score: float | None = None) -> DataFrame:
        """Ranked hits of ``queries(query_id, embedding)``: cosine, best first, ties to the smaller id.

        ``exact`` gives the true ``k`` nearest; otherwise those in the ``probes`` nearest cells.
        """
        spark, content = self.log.spark, self.log.latest().content
        # At most CELLS rows each.
        centres = dict(self.log.read([content["centres"]], "cell int, centre array<double>").toPandas().itertuples(index=False))
        cells = self.log.read([content["cells"]], "cell int, reach double, n bigint").toPandas().sort_values("cell")
        query_type = queries.schema["query_id"].dataType.simpleString()
        if cells.empty:
            return spark.createDataFrame([], f"query_id {query_type}, doc_id {self.doc_type}, score double, rank bigint")
        numbers, reach = cells["cell"].to_numpy(), cells["reach"].to_numpy()
        at = spark.sparkContext.broadcast(np.array([list(centres[c]) for c in numbers]))
        asked = queries.select("query_id", F.col("embedding").cast("array<double>")).filter("embedding is not null")
        blocks = F.broadcast(spark.createDataFrame(
            [(int(c), -(-int(n) // ROW_BLOCK)) for c, n in zip(cells["cell"], cells["n"], strict=True)], "cell int, _rows int"
        ))
        routed_schema = f"query_id {query_type}, embedding array<double>, cell int"

        def routed(choose):
            """Queries with the cells that ``choose(angles, batch)`` marks."""

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if batch.num_rows:
                        row, cell = np.nonzero(choose(angles(units(batch.column(1)), at.value), batch))
                        taken = batch.take(pa.array(row))
                        yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(numbers[cell].astype(np.int32))], ["query_id", "embedding", "cell"])

            return run

        few = min(probes, len(numbers))

        def nearest(gap: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
            return gap.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable") < few

        def not_ruled_out(gap: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
            to_beat = batch.column(2).to_numpy(zero_copy_only=False)
            best = np.round(np.cos(np.maximum(gap - reach - SLACK, 0)), SCORE_DIGITS)
            return (best >= to_beat[:, None]) & ~nearest(gap, batch)

        found = self._compared(content["vectors"], checkpointed(asked.mapInArrow(routed(nearest), routed_schema)), blocks, k)
        if exact:
            found = checkpointed(found)
            kth = top_k(found, ["query_id"], [F.desc("score"), F.asc("doc_id")], k).filter(F.col("rank") == k)
            beaten = asked.join(kth.select("query_id", F.col("score").alias("_kth")), "query_id", "left").select(
                "query_id", "embedding", F.coalesce("_kth", F.lit(-2.0)).alias("_kth")
            )
            more = self._compared(content["vectors"], checkpointed(beaten.mapInArrow(routed(not_ruled_out), routed_schema)), blocks, k)
            found = found.union(more)
        if min_score is not None:
            found = found.filter(F.col("score") >= min_score)
        return top_k(found, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)

    def _compared(self, part: str, asked: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
        """The best ``k`` of every (query, block of a cell)."""
        # At most CELLS of them: only their folders are read.
        needed = [r["cell"] for r in asked.select("cell").distinct().collect()]
        rows = self._read(part).filter(F.col("cell").isin(needed)).join(blocks, "cell")
        sizes = F.broadcast(asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("_queries")))

        def every(count: str) -> F.Column:
            return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

        left = rows.join(sizes, "cell").select(
            "cell", F.expr("cast(pmod(xxhash64(doc_id), _rows) as int)").alias("_r"), every("_queries").alias("_q"), "doc_id", "embedding")
        right = asked.join(sizes, "cell").join(blocks, "cell").select(
            F.col("cell").alias("cell"), F.expr("cast(pmod(xxhash64(query_id), _queries) as int)").alias("_q"), every("_rows").alias("_r"),
            "query_id", F.col("embedding").alias("embedding"))
        right = right.select(*[F.col(c).alias(c) for c in ("cell", "_r", "_q", "query_id", "embedding")])

        def compare(members: pa.Table, questions: pa.Table) -> pa.Table:
            if not (members.num_rows and questions.num_rows):
                return schema.empty_table()
            ids = members.column("doc_id").to_numpy(zero_copy_only=False)
            ids = ids.astype(str) if ids.dtype == object else ids
            keeper = TopKeeper(questions.num_rows, k)
            x, q = units(members.column("embedding")), units(questions.column("embedding"))
            for start in range(0, len(x), 2048):
                keeper.add(ids[start : start + 2048], np.round(x[start : start + 2048] @ q.T, SCORE_DIGITS))
            query, doc, score = keeper.result()
            return pa.table([questions.column("query_id").take(pa.array(query)), pa.array(doc), pa.array(score)], schema=schema)

        query_type = asked.schema["query_id"].dataType.simpleString()
        schema = pa.schema([("query_id", _arrow(query_type)), ("doc_id", _arrow(self.doc_type)), ("score", pa.float64())])
        key = ["cell", "_r", "_q"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
            compare, f"query_id {query_type}, doc_id {self.doc_type}, score double"
        )


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
