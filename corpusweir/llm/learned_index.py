"""Nearest neighbours through learned partitions.

A bounded sample of the vectors gives a neighbour graph, which is cut into balanced parts
with few edges between them.  A small classifier learns which parts the neighbours of a
vector lie in; it puts every vector of the table into its most probable part and sends a
query to the most probable ones until they hold nearly all the probability.  What they
hold is ranked by exact distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusweir.session import written_table

#: Vectors the graph and the classifier are fitted on at most.
SAMPLE = 8192
PARTS, NEIGHBOURS, HIDDEN = 16, 10, 128
#: Share of the true neighbours that the probed parts shall hold on held-out sample queries.
WANTED = 0.96
#: Rows of a part, and queries, that one task compares at most.
ROW_BLOCK, QUERY_BLOCK = 8192, 1024


def nearest(rows: np.ndarray, queries: np.ndarray, k: int, same: bool) -> np.ndarray:
    """Positions of each query's k nearest rows; its own position is left out if ``same``."""
    out = np.empty((len(queries), k), np.int64)
    norms = (rows**2).sum(axis=1)
    for a in range(0, len(queries), 512):
        part = queries[a : a + 512]
        d = norms - 2 * part @ rows.T
        if same:
            d[np.arange(len(part)), np.arange(a, a + len(part))] = np.inf
        out[a : a + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, vectors: np.ndarray, parts: int, random: np.random.RandomState) -> np.ndarray:
    """Cuts a neighbour graph into parts of nearly equal size with few edges between them.

    Starts with halving by principal direction and then moves nodes, in random order, to the
    part that holds most of their neighbours and has room for them.
    """
    n = len(graph)
    part = np.zeros(n, np.int64)
    pieces = [np.arange(n)]
    while len(pieces) < parts:
        halves = []
        for piece in pieces:
            centred = vectors[piece] - vectors[piece].mean(axis=0)
            axis = np.linalg.svd(centred.T @ centred)[0][:, 0]
            order = piece[np.argsort(centred @ axis, kind="stable")]
            halves += [order[: len(order) // 2], order[len(order) // 2 :]]
        pieces = halves
    for i, piece in enumerate(pieces):
        part[piece] = i
    both = [np.concatenate([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])]), np.concatenate([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()])]
    order = np.argsort(both[1], kind="stable")
    target, offsets = both[0][order], np.concatenate(([0], np.cumsum(np.bincount(both[1], minlength=n))))
    size, room = np.bincount(part, minlength=parts), int(1.05 * n / parts) + 1
    for _ in range(12):
        moved = 0
        for i in random.permutation(n):
            votes = np.bincount(part[target[offsets[i] : offsets[i + 1]]], minlength=parts)
            votes[(size >= room) & (np.arange(parts) != part[i])] = -1
            best = int(votes.argmax())
            if votes[best] > votes[part[i]]:
                size[part[i]] -= 1
                size[best] += 1
                part[i] = best
                moved += 1
        if moved < n // 200:
            break
    return part


@dataclass
class Router:
    """One hidden layer and a softmax over the parts; ``mass`` is what the probed parts hold."""

    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: np.ndarray
    mass: float = 1.0

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        logit = np.maximum(x @ self.first + self.first_bias, 0) @ self.second + self.second_bias
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def part(self, x: np.ndarray) -> np.ndarray:
        return self.probabilities(x).argmax(axis=1)

    def probed(self, x: np.ndarray, mass: float | None = None) -> np.ndarray:
        """For every vector and part, whether it is searched."""
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1)
        taken = np.take_along_axis(p, order, axis=1)
        inside = np.cumsum(taken, axis=1) - taken < (self.mass if mass is None else mass)
        out = np.zeros(p.shape, bool)
        np.put_along_axis(out, order, inside, axis=1)
        return out


def train(x: np.ndarray, shares: np.ndarray, random: np.random.RandomState, epochs: int = 40, rate: float = 2e-3) -> Router:
    """Cross entropy against the parts of a vector's neighbours, by Adam."""
    width = x.shape[1]
    values = [
        random.normal(0, (2 / width) ** 0.5, (width, HIDDEN)), np.zeros(HIDDEN),
        random.normal(0, HIDDEN**-0.5, (HIDDEN, shares.shape[1])), np.zeros(shares.shape[1]),
    ]
    mean, square, t = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for _ in range(epochs):
        order = random.permutation(len(x))
        for a in range(0, len(x), 256):
            some = order[a : a + 256]
            hidden = np.maximum(x[some] @ values[0] + values[1], 0)
            logit = hidden @ values[2] + values[3]
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            p = (p / p.sum(axis=1, keepdims=True) - shares[some]) / len(some)
            back = (p @ values[2].T) * (hidden > 0)
            t += 1
            for i, g in enumerate((x[some].T @ back, back.sum(axis=0), hidden.T @ p, p.sum(axis=0))):
                g = g + 1e-4 * values[i]
                mean[i] = 0.9 * mean[i] + 0.1 * g
                square[i] = 0.999 * square[i] + 0.001 * g * g
                values[i] -= rate * (mean[i] / (1 - 0.9**t)) / (np.sqrt(square[i] / (1 - 0.999**t)) + 1e-8)
    return Router(*values)


def fit(sample: np.ndarray, seed: int = 3) -> Router:
    """The router for a sample of distinct vectors.

    A quarter of the sample is left out of the training; the mass to probe is the smallest that
    finds the wanted share of its neighbours.  Small samples have fewer parts, down to one.
    """
    random = np.random.RandomState(seed)
    width = sample.shape[1]
    parts = PARTS
    while parts > 1 and len(sample) < parts * 128:
        parts //= 2
    if parts == 1:
        return Router(np.zeros((width, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    sample = sample[random.permutation(len(sample))]
    used, kept = sample[len(sample) // 4 :], sample[: len(sample) // 4]
    graph = nearest(used, used, NEIGHBOURS, same=True)
    part = balanced_parts(graph, used, parts, random)
    near = np.concatenate([graph, np.arange(len(used))[:, None]], axis=1)
    shares = np.stack([(part[near] == p).mean(axis=1) for p in range(parts)], axis=1)
    router = train(used, shares, random)
    true = nearest(sample, kept, NEIGHBOURS + 1, same=True)[:, :NEIGHBOURS]
    placed = router.part(sample)[true]
    for mass in [*np.arange(0.3, 1.0, 0.02), 0.99, 0.995, 0.999]:
        probed = router.probed(kept, float(mass))
        if np.take_along_axis(probed, placed, axis=1).mean() >= WANTED:
            router.mass = float(mass)
            break
    return router


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``_id, _v`` of the vectors that take part, as doubles."""
    x = F.col(vector_col)
    sized = vectors.filter(x.isNotNull() & F.col(id_col).isNotNull())
    width = sized.groupBy(F.size(x).alias("n")).count().orderBy(F.desc("count"), "n").first()
    good = (
        (F.size(x) == (width["n"] if width else 0))
        & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        & F.exists(x, lambda v: v != 0)
    )
    return sized.filter(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("_id"), x.cast("array<double>").alias("_v"))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def nearest_neighbours(
    vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE
) -> DataFrame:
    """The ``k`` nearest found of every row whose id is divisible by ``every``: query_id, rank, vec_id, score.

    Score is the Euclidean distance in double precision; ties go to the smaller id.  Rows
    with the query's own id are no candidates.  Vectors that are null, zero, of another length
    than most, or hold null or non-finite components take no part, nor do null ids.  Repeated
    rows are candidates each and ask once; rows of one id with different vectors ask together:
    the id has one list, of what is nearest to any of them.  Parts and query sets of any size
    are compared in blocks.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    # A bounded sample, the same every time: the distinct vectors with the smallest hashes.
    chosen = rows.select("_v").distinct().orderBy(F.xxhash64("_v")).limit(sample).toArrow()
    if not chosen.num_rows:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    router = fit(_matrix(chosen.column(0)))
    shared = spark.sparkContext.broadcast(router)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = shared.value.part(_matrix(batch.column(1))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(part)], ["_id", "_v", "_part"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, part = np.nonzero(shared.value.probed(_matrix(batch.column(1))))
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(part.astype(np.int32))], ["_id", "_v", "_part"])

    schema = "_id bigint, _v array<double>, _part int"
    index = written_table(rows.mapInArrow(place, schema))
    asked = written_table(rows.filter(F.col("_id") % every == 0).distinct().mapInArrow(route, schema))
    # As many rows as there are parts.
    sizes = index.groupBy("_part").agg(F.ceil(F.count("*") / ROW_BLOCK).cast("int").alias("_rows"))
    queries = asked.groupBy("_part").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("_queries"))
    blocks = F.broadcast(sizes.join(queries, "_part"))

    def dealt(df: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        return df.join(blocks, "_part").select(
            "_part", F.expr(f"cast(pmod(xxhash64(_id), {own}) as int)").alias(mine),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(theirs), "_id", "_v",
        ).select("_part", "_row_block", "_query_block", "_id", "_v")

    left = dealt(index, "_rows", "_queries", "_row_block", "_query_block")
    right = dealt(asked, "_queries", "_rows", "_query_block", "_row_block")

    def compare(candidates: pa.Table, questions: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if candidates.num_rows and questions.num_rows:
            ids, x = candidates.column("_id").to_numpy(), _matrix(candidates.column("_v"))
            for q, v in zip(questions.column("_id").to_pylist(), _matrix(questions.column("_v")), strict=True):
                gap = x - v
                score = np.sqrt(np.einsum("ij,ij->i", gap, gap))
                score[ids == q] = np.inf
                bound = np.partition(score, k - 1)[k - 1] if len(score) > k else np.inf
                near = np.flatnonzero((score <= bound) & (score < np.inf))
                near = near[np.lexsort((ids[near], score[near]))][:k]
                out[0] += [q] * len(near)
                out[1] += ids[near].tolist()
                out[2] += score[near].tolist()
        types = (pa.int64(), pa.int64(), pa.float64())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "vec_id", "score"), out, types, strict=True)})

    key = ["_part", "_row_block", "_query_block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
