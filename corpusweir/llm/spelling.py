"""Spelling variants: words one edit apart, found in k-d trees over letter counts.

One inserted, deleted or replaced letter moves a word's vector of letter counts by at most
two in the L1 norm: by one between words whose lengths differ by one, by two (or nothing)
between words of one length.  Words of one length are the points of a tree that halves them
letter by letter; words of the same length search it with radius two, those one letter
shorter with radius one, and a box too far away is left out.  What remains close is compared
letter by letter.

The upper nodes of a length's tree, which only say where words go, are fitted on a bounded
sample; below them every cell is searched by tasks that build the rest of the tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweir.session import bounded_broadcast, written_table

SHORTEST, LEAST, RATIO = 7, 2, 10
#: Occurrences in which a letter is dropped: one in so many, chosen by hash.
DROPPED = 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters beyond a-z share so many counts; that only makes vectors closer.
OTHERS = 6
DIMENSIONS = 26 + OTHERS
#: Words a cell should hold; words the upper nodes are fitted on at most; words of a lower leaf.
CELL, SAMPLE, LEAF = 4096, 65_536, 24
#: Words of a block of members or of queries, and letters of one.
MEMBERS, QUERIES, LETTERS = 16_384, 65_536, 1 << 24
#: Pairs of vectors that are compared at once.
PAIRS = 1 << 20


def letters(words: list[str], length: int) -> np.ndarray:
    """One row of code points per word."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def counts(points: np.ndarray) -> np.ndarray:
    """How often each letter occurs, one row per word."""
    place = np.where((points >= 97) & (points <= 122), points - 97, 26 + points % OTHERS).astype(np.int64)
    flat = np.arange(len(points))[:, None] * DIMENSIONS + place
    out = np.bincount(flat.ravel(), minlength=len(points) * DIMENSIONS).reshape(-1, DIMENSIONS)
    return out.astype(np.int8 if points.shape[1] < 60 else np.int32)


@dataclass
class Node:
    letter: int = -1
    most: int = 0
    below: int = -1
    above: int = -1
    leaf: int = -1


class KdTree:
    """Points with ``letter`` counts up to ``most`` lie below a node, the others above."""

    def __init__(self, points: np.ndarray, leaf: int, leaves: int | None = None):
        self.nodes, self.leaves = [Node()], []
        open_ = [(0, np.arange(len(points)))]
        while open_:
            at, members = open_.pop(0)
            cut = self._cut(points[members]) if len(members) > leaf and (leaves is None or len(self.leaves) + len(open_) + 2 <= leaves) else None
            if cut is None:
                self.nodes[at].leaf = len(self.leaves)
                self.leaves.append(members)
                continue
            side = points[members, cut[0]] <= cut[1]
            self.nodes[at] = Node(*cut, len(self.nodes), len(self.nodes) + 1)
            open_ += [(len(self.nodes), members[side]), (len(self.nodes) + 1, members[~side])]
            self.nodes += [Node(), Node()]

    @staticmethod
    def _cut(points: np.ndarray) -> tuple[int, int] | None:
        """The letter and count that halve the points best."""
        best, cut = 0, None
        for most in range(int(points.max(initial=0))):
            smaller = np.minimum(share := (points <= most).sum(axis=0), len(points) - share)
            letter = int(smaller.argmax())
            if smaller[letter] > best:
                best, cut = int(smaller[letter]), (letter, most)
            if most > 64:
                break
        return cut

    def near(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves with the queries whose distance to the leaf's box is at most ``radius``."""
        everything = np.zeros(len(queries), np.int32)
        open_ = [(0, np.arange(len(queries)), everything, {})]
        while open_:
            at, some, far, box = open_.pop()
            node = self.nodes[at]
            if node.leaf >= 0:
                yield node.leaf, some
                continue
            value = queries[some, node.letter].astype(np.int32)
            low, high = box.get(node.letter, (None, None))
            for to, bounds in ((node.below, (low, node.most)), (node.above, (node.most + 1, high))):
                was = (0 if low is None else np.maximum(low - value, 0)) + (0 if high is None else np.maximum(value - high, 0))
                now = (0 if bounds[0] is None else np.maximum(bounds[0] - value, 0)) + (0 if bounds[1] is None else np.maximum(value - bounds[1], 0))
                distance = far - was + now
                keep = distance <= radius
                if keep.any():
                    open_.append((to, some[keep], distance[keep], box | {node.letter: bounds}))

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        out = np.empty(len(points), np.int64)
        for leaf, some in self.near(points, 0):
            out[some] = leaf
        return out


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether rows of code points differ by exactly one replaced or, if ``long`` is longer, one inserted letter."""
    n = short.shape[1]
    same = short == long[:, :n]
    if long.shape[1] == n:
        return (~same).sum(axis=1) == 1
    ahead = np.where(same.all(axis=1), n, same.argmin(axis=1))
    shifted = (short == long[:, 1:])[:, ::-1]
    behind = np.where(shifted.all(axis=1), n, shifted.argmin(axis=1))
    return ahead + behind >= n


def near_pairs(members: list[str], queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Positions (query, member) of words one edit apart; queries are as long as members or one shorter.

    All members have one length, and all queries have one.
    """
    long, short = letters(members, len(members[0])), letters(queries, len(queries[0]))
    vectors, asked = counts(long), counts(short).astype(np.int32)
    vectors = vectors.astype(np.int16) if vectors.dtype == np.int8 else vectors
    tree, radius = KdTree(vectors, LEAF), 2 if long.shape[1] == short.shape[1] else 1
    asked = asked.astype(vectors.dtype)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for leaf, some in tree.near(asked, radius):
        own = tree.leaves[leaf]
        step = max(1, PAIRS // (len(own) * DIMENSIONS))
        for start in range(0, len(some), step):
            part = some[start : start + step]
            distance = np.zeros((len(part), len(own)), vectors.dtype)
            for letter in range(DIMENSIONS):
                distance += np.abs(asked[part, letter][:, None] - vectors[own, letter])
            i, j = np.nonzero(distance <= radius)
            q, m = part[i], own[j]
            good = np.concatenate([np.zeros(0, bool), *[one_edit(short[q[a : a + 65_536]], long[m[a : a + 65_536]]) for a in range(0, len(q), 65_536)]])
            found.append((q[good], m[good]))
    return tuple(np.concatenate([np.zeros(0, np.int64), *[f[k] for f in found]]) for k in (0, 1))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n`` of all words long enough, a letter dropped from some of their occurrences."""
    run = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[A-Za-zÀ-ÿ]{{{SHORTEST},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), run.alias("_run")).select(
        "_id", F.translate("_run", UPPER, LOWER).alias("_run")
    )
    hashed = runs.select("_run", F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary")).alias("_h"))
    dropped = F.expr("concat(substring(_run, 1, cast(_h % length(_run) as int)), substring(_run, cast(_h % length(_run) as int) + 2))")
    word = F.when(F.col("_h") % DROPPED == 0, dropped).otherwise(F.col("_run"))
    words = hashed.select(word.alias("word")).filter(F.length("word") >= SHORTEST)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST)


def _upper_trees(words: DataFrame, cell: int) -> dict[int, KdTree]:
    """For each length with more words than a cell, a tree with about as many cells as needed."""
    sizes = {r["_len"]: r["n"] for r in words.groupBy("_len").agg(F.count("*").alias("n")).filter(F.col("n") > cell).collect()}
    if not sizes:
        return {}
    total = sum(sizes.values())
    chosen = words.filter(F.col("_len").isin(list(sizes))).filter(
        F.pmod(F.xxhash64("word"), F.lit(1_000_003)) < F.lit(min(1.0, SAMPLE / total) * 1_000_003)
    ).select("word", "_len").toPandas()
    return {
        int(n): KdTree(counts(letters(sorted(part["word"]), int(n))), 1, leaves=2 * -(-sizes[n] // cell))
        for n, part in chosen.groupby("_len")
    }


def _routed(trees: dict[int, KdTree]):
    """Rows (tree, cell, asks, home, word, n): each word as a member of its cell and as a query of all near ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            length = np.array([len(w) for w in words])
            for size in np.unique(length):
                where = np.flatnonzero(length == size)
                own = trees.get(int(size))
                vectors = counts(letters([words[i] for i in where], int(size))) if own or int(size) + 1 in trees else None
                home = own.leaf_of(vectors) if own else np.zeros(len(where), np.int64)
                parts = [(int(size), home, False, home, np.arange(len(where)))]
                # Words of one length: a pair of cells is searched from the later one.
                for cell, some in own.near(vectors, 2) if own else [(0, np.arange(len(where)))]:
                    some = some[home[some] >= cell]
                    parts.append((int(size), np.full(len(some), cell), True, home[some], some))
                longer = trees.get(int(size) + 1)
                for cell, some in longer.near(vectors, 1) if longer else [(0, np.arange(len(where)))]:
                    parts.append((int(size) + 1, np.full(len(some), cell), True, np.full(len(some), -1), some))
                for tree, cell, asks, from_, some in parts:
                    if len(some):
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(len(some), tree, np.int32)), pa.array(cell.astype(np.int32)), pa.array(np.full(len(some), asks)),
                            pa.array(from_.astype(np.int32)), batch.column(0).take(pa.array(where[some])), pa.array(n[where[some]]),
                        ], ["_tree", "_cell", "_asks", "_home", "word", "n"])

    return run


def _search(members: pa.Table, queries: pa.Table) -> pa.Table:
    word, near, near_n = [], [], []
    if members.num_rows and queries.num_rows:
        own, n = members.column("word").to_pylist(), members.column("n").to_numpy()
        cell = members.column("_cell")[0].as_py()
        asked, asked_n, home = (queries.column(c).to_numpy(zero_copy_only=False) for c in ("word", "n", "_home"))
        for shorter in (False, True):
            some = np.flatnonzero((home < 0) == shorter)
            if len(some):
                words = asked[some].tolist()
                q, m = near_pairs(own, words)
                for i, j in zip(q.tolist(), m.tolist(), strict=True):
                    # Within one cell both words ask: the pair counts once.
                    if shorter or home[some[i]] != cell or words[i] < own[j]:
                        word += [words[i], own[j]]
                        near += [own[j], words[i]]
                        near_n += [n[j], asked_n[some[i]]]
    return pa.table({"word": pa.array(word, pa.string()), "near": pa.array(near, pa.string()), "near_n": pa.array(near_n, pa.int64())})


def near_words(words: DataFrame, cell: int = CELL, block: int = MEMBERS, asked: int = QUERIES) -> DataFrame:
    """``word, near, near_n``: every ordered pair of different words one edit apart, from ``words(word, n)``."""
    words = words.withColumn("_len", F.length("word"))
    trees = words.sparkSession.sparkContext.broadcast(_upper_trees(words, cell))

    def route(batches):
        yield from _routed(trees.value)(batches)

    routed = written_table(words.select("word", "n").mapInArrow(
        route, "_tree int, _cell int, _asks boolean, _home int, word string, n bigint"
    ))
    at = ["_tree", "_cell"]
    fit = lambda most: F.greatest(F.lit(1), F.least(F.lit(most), F.lit(LETTERS) / F.col("_tree")))
    sizes = bounded_broadcast(routed.groupBy(*at).agg(
        F.ceil(F.count_if(~F.col("_asks")) / fit(block)).cast("int").alias("_members"),
        F.ceil(F.count_if("_asks") / fit(asked)).cast("int").alias("_queries"),
    ).filter("_members > 0 and _queries > 0"))
    dealt = routed.join(sizes, at)

    def blocks(asks: bool) -> DataFrame:
        mine, theirs = ("_queries", "_members") if asks else ("_members", "_queries")
        own = F.expr(f"cast(pmod(xxhash64(word), {mine}) as int)")
        other = F.explode(F.sequence(F.lit(0), F.col(theirs) - 1))
        return dealt.filter(F.col("_asks") == asks).select(
            *at, (other if asks else own).alias("_mb"), *([own.alias("_qb")] if asks else [F.col("_queries")]), *([] if asks else ["_members"]),
            "_home", "word", "n",
        )

    # Other names: both sides of a cogroup must not be the same columns.
    queries = blocks(True).select(*[F.col(c).alias(c) for c in (*at, "_mb", "_qb", "_home", "word", "n")])
    members = blocks(False).withColumn("_qb", F.explode(F.sequence(F.lit(0), F.col("_queries") - 1))).drop("_queries", "_members")
    key = [*at, "_mb", "_qb"]
    return members.select(*key, "word", "n").groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(
        _search, "word string, near string, near_n bigint"
    )


def last_forms(forms: DataFrame) -> DataFrame:
    """``word, root``: where following ``forms(word, form)`` ends, by doubling the steps taken.

    Every step leads to a word at least ten times as frequent, so few rounds are needed.
    """
    now = written_table(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        far = written_table(now.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        if far.filter("_moved").isEmpty():
            return far.select("word", "root")
        now = far.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cell: int = CELL) -> DataFrame:
    """Every frequent enough word with its likely form: word, form, root, n, n_near, form_n.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF of at least seven letters, lower-cased
    in A-Z only, that occur twice or more; in one of 31 occurrences, chosen by the crc32 of
    ``id:run``, a letter is dropped first (a null id counts as empty).  A word's form is its near
    word of largest ``n``, ties to the smallest in code-point order, if that is at least ten
    times its own; ``root`` is where forms end.  Null and empty texts have no words; repeated
    rows count again; words of any length are compared whole; an empty table gives no rows.
    """
    words = written_table(word_counts(docs, id_col, text_col))
    best = near_words(words, cell).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("_less"), "near")).alias("_best")
    )
    marked = written_table(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("_best._less") >= RATIO * F.col("n"), F.col("_best.near")).alias("form"),
        F.when(-F.col("_best._less") >= RATIO * F.col("n"), -F.col("_best._less")).alias("form_n"),
    ))
    roots = last_forms(marked.filter("form is not null"))
    return marked.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
