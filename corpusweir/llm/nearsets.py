"""Links between similar sets, found through b-bit MinHash and confirmed exactly.

Each distinct set is an item with band keys and a packed sketch of the low bits of its
minima.  Items that share a band key are compared with the smallest of them only, if
their sketches and sizes allow the wanted similarity, so a bucket of any size costs as
many pairs as it has members.  What that leaves open are members of one bucket that are
still in different components.  In small buckets the sketches choose the pairs to
confirm; in larger ones members are compared inside tasks, block by block: the texts
travel, no pairs do, and only links that join components come out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweir.llm.components import components
from corpusweir.llm.shingling import MinHash, band_keys, distinct_runs, jaccard, line_shingles, word_shingles, words
from corpusweir.session import written_table

#: Buckets up to this size are joined with themselves under the sketches; in larger ones the texts travel.
SMALL = 32
#: Members of a block; a task holds two blocks of texts at most.
BLOCK = 1024
#: Code points of texts that are shingled together; a longer text is taken alone.
TOGETHER = 1 << 20


def together(texts: list[str], limit: int = TOGETHER) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of at most ``limit`` code points, or of one longer text."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


@dataclass(frozen=True)
class Similarity:
    """Sets of ``k``-shingles of words or of characters, and how they are compared.

    The first ``bands * rows`` of the ``hashes`` minima make band keys (all, by default);
    ``bits`` low bits of each are kept for the sketch.  ``hashes`` is a multiple of 64.
    """

    unit: str
    k: int
    hashes: int
    rows: int
    percent: int = 80
    bits: int = 2
    seed: int = 1
    bands: int = 0

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """Sorted distinct shingle hashes.  A text shorter than a shingle has one, an empty one none."""
        if self.unit == "chars":
            out = []
            for a, b in together(texts):
                out += distinct_runs(*line_shingles(texts[a:b], self.k))
            return out
        data = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        out = []
        for t in data:
            hashes, _, _, offsets = words([t])
            out.append(np.unique(word_shingles(hashes, offsets, self.k)[0]))
        return out

    def minima(self, sets: list[np.ndarray]) -> np.ndarray:
        offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)
        return MinHash(self.hashes, self.seed).minima_of(np.concatenate([np.zeros(0, np.uint64), *sets]), offsets)

    def keys(self, minima: np.ndarray) -> np.ndarray:
        bands = self.bands or self.hashes // self.rows
        return band_keys(minima[:, : bands * self.rows], self.rows)

    def sketch(self, minima: np.ndarray) -> np.ndarray:
        """The low bits of the minima, one plane of 64-bit words per bit."""
        planes = []
        for bit in range(self.bits):
            taken = ((minima >> np.uint32(bit)) & np.uint32(1)).astype(np.uint8)
            planes.append(np.packbits(taken, axis=1, bitorder="little").view(np.int64))
        return np.concatenate(planes, axis=1)

    @property
    def least_matches(self) -> int:
        """Equal low-bit minima below which a pair is not looked at.

        Two different minima agree by chance with probability 2^-bits, for which the
        estimate is corrected.  The bound lies five standard deviations below the wanted
        similarity, so one true link in three million is missed.
        """
        chance = 0.5**self.bits
        p = chance + (1 - chance) * self.percent / 100
        return int(self.hashes * p - 5 * (self.hashes * p * (1 - p)) ** 0.5)

    def similar(self, a: np.ndarray, b: np.ndarray) -> bool:
        shared, union = jaccard(a, b)
        return 100 * shared >= self.percent * union > 0

    def similar_among(self, a: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        """Which of the ``others`` are similar to ``a``; all are sorted and distinct, ``a`` is not empty."""
        sizes = np.array([len(o) for o in others], np.int64)
        values = np.concatenate(others)
        at = np.minimum(np.searchsorted(a, values), len(a) - 1)
        met = np.concatenate(([0], np.cumsum(a[at] == values)))
        ends = np.cumsum(sizes)
        shared = met[ends] - met[ends - sizes]
        return (shared > 0) & (100 * shared >= self.percent * (len(a) + sizes - shared))

    def sizes_allow(self, n: Column, m: Column) -> Column:
        """What the sizes of two sets allow; a size of 0 is not known."""
        return (F.least(n, m) == 0) | (F.least(n, m) * 100 >= F.greatest(n, m) * self.percent)

    def sketches_allow(self, a: Column, b: Column) -> Column:
        """Counts the minima that agree in all their kept bits, 64 at a time."""
        per, total = self.hashes // 64, None
        for w in range(per):
            differ = None
            for bit in range(self.bits):
                x = F.get(a, F.lit(bit * per + w)).bitwiseXOR(F.get(b, F.lit(bit * per + w)))
                differ = x if differ is None else differ.bitwiseOR(x)
            same = F.bit_count(F.bitwise_not(differ))
            total = same if total is None else total + same
        return total >= self.least_matches


def confirm(pairs: DataFrame, texts: DataFrame, similarity: Similarity) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough; ``texts(id, text)`` has both ends."""
    sided = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("_tb")), "b").join(
        texts.select(F.col("id").alias("a"), F.col("text").alias("_ta")), "a"
    ).select("a", "b", "_ta", "_tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            left = [t or "" for t in batch.column(2).to_pylist()]
            right = [t or "" for t in batch.column(3).to_pylist()]
            keep = []
            for start, end in together(right):
                # Pairs come with equal left ends beside each other; each run of them is shingled once.
                new = [i for i in range(start, end) if ids[i] != (ids[i - 1] if i > start else last)]
                lefts = dict(zip(new, similarity.sets([left[i] for i in new]), strict=True))
                for i, other in enumerate(similarity.sets(right[start:end]), start):
                    held = lefts.get(i, held)
                    keep.append(similarity.similar(held, other))
                last = ids[end - 1]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return sided.mapInArrow(run, "a bigint, b bigint")


def _block_links(similarity: Similarity) -> Callable[[pa.Table], pa.Table]:
    """Links between different components among the members of a bucket's two blocks."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        key, first, second = (table.column(c)[0].as_py() for c in ("key", "first", "second"))
        ids = table.column("id").to_numpy()
        block = table.column("block").to_numpy()
        _, root = np.unique(table.column("root").to_numpy(), return_inverse=True)
        found: list[tuple[int, int]] = []
        place = np.arange(len(ids))
        sketch = np.stack(table.column("sketch").to_numpy()).view(np.uint64).reshape(len(ids), similarity.bits, -1)

        def near(i: int) -> np.ndarray:
            """Members to compare ``i`` with, by block, component and sketch."""
            js = np.flatnonzero((root != root[i]) & ((place > i) if first == second else (block == second)))
            differ = np.bitwise_or.reduce(sketch[js] ^ sketch[i], axis=1)
            return js[similarity.hashes - np.bitwise_count(differ).sum(axis=1, dtype=np.int64) >= similarity.least_matches]

        leads = np.flatnonzero(block == first) if len(np.unique(root)) > 1 else place[:0]
        asked = np.zeros(len(ids), bool)
        for i in leads:
            js = near(i)
            asked[js] = True
            asked[i] |= len(js) > 0
        # Only texts that a sketch lets through are shingled.
        chosen = np.flatnonzero(asked)
        texts = table.column("text").take(pa.array(chosen)).to_pylist()
        some = similarity.sets([t or "" for t in texts])
        some_keys = similarity.keys(similarity.minima(some)) if some else np.zeros((0, 1), np.int64)
        sets = dict(zip(chosen.tolist(), some, strict=True))
        row = np.cumsum(asked) - 1
        size = np.zeros(len(ids), np.int64)
        size[chosen] = [len(s) for s in some]
        for i in leads[asked[leads]]:
            js = near(i)
            js = js[np.minimum(size[js], size[i]) * 100 >= np.maximum(size[js], size[i]) * similarity.percent]
            # A pair that shares an earlier band meets in that bucket as well.
            mine = some_keys[row[i]]
            band = int(np.flatnonzero(mine == key)[0])
            js = js[~(some_keys[row[js], :band] == mine[:band]).any(axis=1)]
            if len(js) and size[i]:
                for j in js[similarity.similar_among(sets[int(i)], [sets[int(j)] for j in js])]:
                    if root[i] != root[j]:
                        found.append((int(ids[i]), int(ids[j])))
                        root[root == root[j]] = root[i]
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def blocked(members: DataFrame) -> DataFrame:
    """Members of open buckets ``(key, id, root)`` with their ``block`` and the number of blocks they meet.

    The largest component of a bucket hangs together already, so its members meet those of all
    other components only: these fill the first blocks and meet every block, the largest one's
    fill the blocks behind and meet the first ones.  With few strays every other member travels once.
    A bucket that fits a block is one.
    """
    sizes = members.groupBy("key", "root").agg(F.count("*").alias("_c"))
    most = sizes.groupBy("key").agg(F.max(F.struct("_c", "root")).alias("_most"), F.sum("_c").alias("_all")).select(
        "key", F.col("_most.root").alias("_hub"),
        F.ceil((F.col("_all") - F.col("_most._c")) / BLOCK).cast("int").alias("_strays"),
        F.ceil(F.col("_most._c") / BLOCK).cast("int").alias("_hubs"),
    )
    met = members.join(most.withColumn("_one", F.col("_strays") + F.col("_hubs") == 2), "key")
    inside = F.col("root") == F.col("_hub")
    return met.select(
        "key", "id", "root",
        F.when(F.col("_one"), F.lit(0)).when(inside, F.expr("cast(_strays + pmod(xxhash64(id), _hubs) as int)"))
        .otherwise(F.expr("cast(pmod(xxhash64(id), _strays) as int)")).alias("block"),
        F.when(F.col("_one"), F.lit(1)).when(inside, F.col("_strays")).otherwise(F.col("_strays") + F.col("_hubs")).alias("_others"),
    )


def linked(
    items: DataFrame,
    texts_of: Callable[[DataFrame], DataFrame],
    similarity: Similarity,
    rows: DataFrame | None = None,
) -> DataFrame:
    """``(id, root)`` of the components of similar items; items that are their own root are left out.

    ``items(id, n, keys, sketch)`` holds every distinct set, in equal rows if more than
    once; ``texts_of(ids)`` gives ``(id, text)`` once for each of the ids asked for.
    ``rows(key, id)`` may give the band rows that matter, where most keys are known to be alone.
    """
    if rows is None:
        rows = items.select("id", F.explode("keys").alias("key"))
    leads = rows.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("_last")).filter("lead < _last")
    shared = written_table(rows.join(leads.select("key", "lead"), "key").filter("id <> lead"))
    signs = items.select("id", "n", "sketch")
    pairs = shared.select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    for side in ("a", "b"):
        pairs = pairs.join(signs.select(F.col("id").alias(side), F.col("n").alias(f"_n{side}"), F.col("sketch").alias(f"_s{side}")), side)
    pairs = written_table(
        pairs.filter(similarity.sizes_allow(F.col("_na"), F.col("_nb")))
        .filter(similarity.sketches_allow(F.col("_sa"), F.col("_sb"))).select("a", "b").distinct()
    )
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    links = written_table(confirm(pairs, texts_of(ends), similarity))
    roots = components(links)
    labelled = shared.join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    split = labelled.groupBy("key").agg(
        F.min("root").alias("_low"), F.max("root").alias("_high"), F.count("*").alias("_n")
    ).filter("_low < _high").select("key", "_n")
    open_rows = written_table(labelled.join(split, "key"))
    few = open_rows.filter(F.col("_n") <= SMALL).select("key", "id", "root").join(signs, "id")
    sides = [few.select("key", *[F.col(c).alias(f"_{x}{c}") for c in ("id", "root", "n", "sketch")]) for x in "ab"]
    near = sides[0].join(
        sides[1],
        (sides[0]["key"] == sides[1]["key"]) & (F.col("_aid") < F.col("_bid")) & (F.col("_aroot") != F.col("_broot"))
        & similarity.sizes_allow(F.col("_an"), F.col("_bn"))
        & similarity.sketches_allow(F.col("_asketch"), F.col("_bsketch")),
    )
    close = written_table(near.select(F.col("_aid").alias("a"), F.col("_bid").alias("b")).distinct())
    ends = close.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    links = links.union(confirm(close, texts_of(ends), similarity))
    placed = blocked(open_rows.filter(F.col("_n") > SMALL))
    ids = written_table(placed.select("id").distinct())
    # Text and sketch meet once per member, before its rows are dealt to the other blocks.
    held = texts_of(ids).join(signs.select("id", "sketch"), "id")
    blocks = placed.join(held, "id").withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_others") - 1))).select(
        "key", "id", "root", "block",
        F.least("block", "_other").alias("first"), F.greatest("block", "_other").alias("second"), "text", "sketch",
    )
    more = blocks.groupBy("key", "first", "second").applyInArrow(_block_links(similarity), "a bigint, b bigint")
    return components(links.union(more))
