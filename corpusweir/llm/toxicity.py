"""Toxicity by averaged subword embeddings and a linear softmax.

A text is the mean of the embeddings of its words and their character n-grams, all hashed
into one table; a linear layer with softmax follows.  Embeddings and layer are trained
together in numpy, so a misspelt word that was never seen still has the n-grams of words
that were.  As the layer is linear, a trained feature comes down to one number, the
difference it makes to the logit, and a text's score to the mean of those.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweir.llm.shingling import run_hashes

GRAMS = (3, 4, 5)
BUCKETS = 1 << 17
DIMENSION = 8
#: Neutral features that every text has besides its own, so that few words are no strong evidence.
PADDING = 400
#: Toxic rows the model is fitted on at most, and twice as many others.
SAMPLE = 1500
#: Words a task keeps the weight of.
STORE = 300_000


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every feature: the word itself and its n-grams, with ends marked."""
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    begins = np.concatenate(([0], np.cumsum(n)))[:-1]
    number, hashed = [np.arange(len(words))], [run_hashes(codes, begins, begins + n)]
    for g in GRAMS:
        counts = np.maximum(n - g + 1, 0)
        out = np.concatenate(([0], np.cumsum(counts)))
        at = np.repeat(begins - out[:-1], counts) + np.arange(out[-1])
        number.append(np.repeat(np.arange(len(words)), counts))
        hashed.append(run_hashes(codes, at, at + g))
    return np.concatenate(number), (np.concatenate(hashed) & np.uint64(BUCKETS - 1)).astype(np.int64)


def text_words(text: str | None) -> list[str]:
    return (text or "").lower().split()


@dataclass
class Model:
    weight: np.ndarray
    bias: float

    def probability(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(sums / (counts + PADDING) + self.bias, -30, 30)))


def _rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as sparse rows: offsets, buckets and the share of the features in each."""
    offsets, columns, shares = [0], [], []
    for text in texts:
        words = text_words(text)
        if words:
            distinct = list(dict.fromkeys(words))
            place = {w: i for i, w in enumerate(distinct)}
            times = np.bincount([place[w] for w in words])
            number, bucket = features(distinct)
            order = np.argsort(bucket, kind="stable")
            bucket, weight = bucket[order], times[number[order]].astype(float)
            first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            weight = np.add.reduceat(weight, first)
            columns.append(bucket[first].astype(np.int32))
            shares.append((weight / (weight.sum() + PADDING)).astype(np.float32))
        offsets.append(offsets[-1] + (len(columns[-1]) if words else 0))
    none = np.zeros(0, np.int32)
    return np.array(offsets), np.concatenate(columns or [none]), np.concatenate(shares or [none.astype(np.float32)])


def fit(
    texts: list[str], labels: list[int], epochs: int = 10, least_steps: int = 600, batch: int = 32, rate: float = 0.5, seed: int = 5
) -> Model:
    """Embeddings and softmax by stochastic gradient descent with per-value rates (Adagrad).

    Small samples are gone through more often, until ``least_steps`` batches are done.
    """
    y = np.array(labels, np.int64)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    prior = float(np.log(share / (1 - share)))
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS), prior if len(y) else -3.0)
    offsets, columns, shares = _rows(texts)
    random = np.random.RandomState(seed)
    embedding = random.uniform(-1, 1, (BUCKETS, DIMENSION)) / DIMENSION
    layer = random.uniform(-1, 1, (DIMENSION, 2))
    bias = np.array([0.0, prior])
    seen = [np.full(x.shape, 1e-8) for x in (embedding, layer, bias)]
    for _ in range(max(epochs, -(-least_steps * batch // len(y)))):
        order = random.permutation(len(y))
        for a in range(0, len(order), batch):
            some = order[a : a + batch]
            lengths = offsets[some + 1] - offsets[some]
            at = np.repeat(offsets[some] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
            row, column, part = np.repeat(np.arange(len(some)), lengths), columns[at], shares[at]
            hidden = np.zeros((len(some), DIMENSION))
            filled = np.flatnonzero(lengths)
            if len(filled):
                starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))[filled]
                hidden[filled] = np.add.reduceat(embedding[column] * part[:, None], starts, axis=0)
            logit = hidden @ layer + bias
            logit -= logit.max(axis=1, keepdims=True)
            p = np.exp(logit)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            p /= len(some)
            back = p @ layer.T
            used, place = np.unique(column, return_inverse=True)
            step = np.stack([np.bincount(place, part * back[row, d], len(used)) for d in range(DIMENSION)], axis=1)
            for value, total, gradient, where in (
                (embedding, seen[0], step, used), (layer, seen[1], hidden.T @ p, slice(None)), (bias, seen[2], p.sum(axis=0), slice(None)),
            ):
                total[where] += gradient * gradient
                value[where] -= rate * gradient / np.sqrt(total[where])
    return Model(embedding @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]))


class Scorer:
    """Scores texts; the weights of words met before are looked up."""

    def __init__(self, model: Model):
        self.model, self.place = model, {}
        self.sums, self.counts = np.zeros(0), np.zeros(0)

    def learn(self, words: list[str]) -> None:
        number, bucket = features(words)
        for i, w in enumerate(words, len(self.place)):
            self.place[w] = i
        self.sums = np.concatenate([self.sums, np.bincount(number, self.model.weight[bucket], len(words))])
        self.counts = np.concatenate([self.counts, np.bincount(number, minlength=len(words)).astype(float)])

    def score(self, texts: list[str | None]) -> np.ndarray:
        split = [text_words(t) for t in texts]
        if len(self.place) > STORE:
            self.place, self.sums, self.counts = {}, np.zeros(0), np.zeros(0)
        new = list(dict.fromkeys(w for words in split for w in words if w not in self.place))
        if new:
            self.learn(new)
        sums, counts = np.zeros(len(texts)), np.zeros(len(texts))
        for i, words in enumerate(split):
            if words:
                at = [self.place[w] for w in words]
                sums[i], counts[i] = self.sums[at].sum(), self.counts[at].sum()
        return self.model.probability(sums, counts)


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(
    docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str, label_col: str
) -> DataFrame:
    """``(_id, _text, _y)`` of ``sample`` toxic and twice as many other rows at most, the same ones every time.

    Rows whose id's CRC-32 is divisible by 5 are held out.  The rows are chosen by a hash of
    their id among all labelled rows.
    """
    usable = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter(
        ~held_out(F.col("_id")) & F.col("_y").isin(0, 1) & F.col("_id").isNotNull()
    )
    chosen = None
    for y in (0, 1):
        some = usable.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample * (2 - y))
        chosen = some if chosen is None else chosen.union(some)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return texts.join(F.broadcast(chosen.dropDuplicates(["_id"])), "_id").dropDuplicates(["_id"]).select("_id", "_text", "_y")


def fitted(docs: DataFrame, labels: DataFrame, sample: int, **names: str) -> Model:
    """The model of the sample, fitted in one task, by ascending id; only its weights reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            y += batch.column(1).to_pylist()
        model = fit(texts, y)
        yield pa.RecordBatch.from_pydict({"weight": [model.weight.astype("<f8").tobytes()], "bias": [model.bias]})

    rows = labelled_sample(docs, labels, sample, **names).repartition(1).sortWithinPartitions("_id")
    found = rows.select("_text", "_y").mapInArrow(run, "weight binary, bias double").first()
    return Model(np.frombuffer(found["weight"], "<f8"), found["bias"]) if found else fit([], [])


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = SAMPLE,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, held_out, score (0 to 1), predicted (1 from 0.5 on).

    Only the text makes the score; null and empty texts get that of the prior alone.
    Null ids are scored and held out of the fit like ids without a label; repeated rows are
    scored each.  Without labels of both classes every text gets the share of the one there
    is, or a low score.  Other columns are not read.
    """
    model = fitted(docs, labels, sample, id_col=id_col, text_col=text_col, label_col=label_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(scorer.score(part.column(1).to_pylist()))], ["_id", "score"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, score double")
    return scored.select(
        F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, in the same columns; one pass over the rows."""
    names = {k: options.get(k, d) for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("label_col", "toxic"))}
    model = fitted(docs, labels, options.get("sample", SAMPLE), **names)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(names["text_col"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                yield part.filter(pa.array(scorer.score(part.column(at).to_pylist()) < 0.5))

    return docs.mapInArrow(run, docs.schema)
