"""Centroid clustering by progressive search over Walsh-Hadamard coefficients.

Vectors and centroids are integers, and so are their Walsh-Hadamard coefficients: the
transform only adds and subtracts, and multiplies every squared distance by the width.  A
vector meets all centroids in the few coarsest coefficients first.  The most promising one
is finished at once, its distance is a bound, and centroids whose differences so far are
strictly greater can never win; only the others are carried on to finer coefficients, up to
all 64.  The outcome is the exact nearest centroid.

Spark keeps the rows: each round is one scan that adds up the vectors of each cluster inside
tasks; only one row per cluster and task is shuffled and one row per cluster reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweir.session import written_table

WIDTH, SCALE = 64, 256
#: After how many coefficients centroids are ruled out.
STEPS = (4, 8, 16, 32, WIDTH)
#: Components must be smaller than this, so that all sums of squares fit a long.
LIMIT = 65_536
#: Vectors times centroids that are compared at once.
BLOCK = 1 << 18
MOST = np.iinfo(np.int64).max


def walsh() -> np.ndarray:
    """The 64 Walsh functions, from the constant one to the one with most changes of sign."""
    h = np.ones((1, 1))
    while len(h) < WIDTH:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((np.diff(h, axis=1) != 0).sum(axis=1))]


def coefficients(x: np.ndarray) -> np.ndarray:
    """The transform of integer rows; doubles hold all its sums exactly."""
    return (x.astype(np.float64) @ walsh().T).astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of and squared distance to the nearest centroid, ties to the smaller number.

    Both sides are coefficients.  Also tells how many squared differences were formed.
    """
    cluster, distance, formed = np.empty(len(x), np.int32), np.empty(len(x), np.int64), 0
    step = max(1, BLOCK // len(centroids))
    for start in range(0, len(x), step):
        part = x[start : start + step]
        sums, seen = np.zeros((len(part), len(centroids)), np.int64), 0
        alive = np.ones(sums.shape, bool)
        bound = np.full(len(part), MOST)
        for upto in STEPS:
            row, number = np.nonzero(alive)
            gap = part[row, seen:upto] - centroids[number, seen:upto]
            sums[row, number] += np.einsum("ij,ij->i", gap, gap)
            formed += gap.size
            seen = upto
            leader = np.where(alive, sums, MOST).argmin(axis=1)
            if upto < WIDTH:
                rest = part[:, upto:] - centroids[leader, upto:]
                bound = np.minimum(bound, sums[np.arange(len(part)), leader] + np.einsum("ij,ij->i", rest, rest))
                formed += rest.size
                alive &= sums <= bound[:, None]
        cluster[start : start + step] = leader
        distance[start : start + step] = sums[np.arange(len(part)), leader] // WIDTH
    return cluster, distance, formed


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), WIDTH)


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``_id, _x``: the vectors of exactly 64 finite components as integers."""
    x = F.col(vector_col)
    good = (F.size(x) == WIDTH) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    scaled = F.transform(x, lambda v: F.when(F.abs(v) < LIMIT, F.floor(v.cast("double") * SCALE).cast("int")).otherwise(
        F.raise_error(F.lit(f"a component is not within {LIMIT}: squared distances might not fit a long"))
    ))
    return vectors.filter(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("_id"), scaled.alias("_x"))


def progressive_clusters(
    vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The cluster of every kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly 64 components, none null or not finite; a component beyond
    65536 is an error, since distances would not fit.  The first centroids are the ``k`` kept
    vectors (all, if fewer) with the smallest sha256 of ``seed:id``; ties go by id, then by
    components.  Each round replaces every non-empty centroid by the floor of its vectors'
    mean.  Repeated rows count each; null ids take part, but come last as first centroids.
    Other columns are ignored, and without kept vectors the result is empty.
    """
    spark = vectors.sparkSession
    kept = written_table(integer_vectors(vectors, id_col, vector_col))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256)
    first = kept.orderBy(key.asc_nulls_last(), "_id", "_x").limit(k).collect()
    schema = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = np.array([r["_x"] for r in first], np.int64)

    def totals(now: np.ndarray):
        target = coefficients(now)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, sums = np.zeros(len(now), np.int64), np.zeros(now.shape, np.int64)
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column(0)).astype(np.int64)
                    cluster = nearest(coefficients(x), target)[0]
                    order = np.argsort(cluster, kind="stable")
                    present, starts = np.unique(cluster[order], return_index=True)
                    n[present] += np.diff([*starts, len(order)])
                    sums[present] += np.add.reduceat(x[order], starts, axis=0)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([
                pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.int64())),
            ], ["cluster", "n", "sums"])

        return run

    def assigned(now: np.ndarray):
        target = coefficients(now)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cluster, distance, _ = nearest(coefficients(_matrix(batch.column(1))), target)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"]
                    )

        return run

    for _ in range(rounds):
        added = kept.select("_x").mapInArrow(totals(centroids), "cluster int, n bigint, sums array<bigint>")
        # One row per centroid.
        for row in added.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]) for i in range(WIDTH)]).collect():
            centroids[row["cluster"]] = [s // row["n"] for s in row[2:]]
    placed = written_table(kept.mapInArrow(assigned(centroids), "vec_id bigint, cluster int, distance bigint"))
    inertia = {r["cluster"]: int(r["d"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    total = sum(inertia.values())
    described = spark.createDataFrame(
        [
            (c, d, total, hashlib.sha256(",".join(str(v) for v in centroids[c].tolist()).encode()).hexdigest())
            for c, d in inertia.items()
        ],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    )
    return placed.join(F.broadcast(described), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
