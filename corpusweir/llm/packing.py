"""Best-fit packing of token pieces by exact complements.

All decisions are taken on the number of pieces per length, at most as many counts as a
sequence has tokens, whatever the size of the corpus.  The plan is a list of groups
(lengths of one sequence, number of such sequences).  It begins with the longest pieces:
a gap is closed exactly by one, two or three pieces whose lengths sum up to it, found
through an index of single, pair and triple sums and consumed as often as the counts
allow.  Pieces without an exact complement are packed best-fit, longest first.  Each piece
then finds its sequence from its rank among the pieces of its length.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweir.llm.shingling import chunks
from corpusweir.llm.tokens import tokenizer_text, word_tokens
from corpusweir.operators.ordering import positions
from corpusweir.session import written_table

Group = tuple[tuple[int, ...], int]


class SumIndex:
    """Which lengths have pieces left, and for every sum a pair of them that makes it.

    A pair is looked up again only when one of its lengths ran out.
    """

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.pair = np.full(len(counts), -1, np.int64)

    def fits(self, lengths: tuple[int, ...]) -> int:
        """How many times these lengths can be taken together."""
        return min(int(self.counts[x]) // lengths.count(x) for x in set(lengths))

    def pair_of(self, total: int) -> int:
        """The longer length of a pair with this sum; 0 if there is none."""
        a = int(self.pair[total])
        if a > 0 and self.fits((a, total - a)):
            return a
        if a != 0:
            long = np.arange((total + 1) // 2, total)
            good = (self.counts[long] > 0) & (self.counts[total - long] > (long * 2 == total))
            found = np.flatnonzero(good)
            self.pair[total] = a = int(long[found[-1]]) if len(found) else 0
        return a

    def complement(self, first: int, gap: int) -> tuple[int, ...] | None:
        """One to three lengths that, beside a piece of length ``first``, fill the gap exactly."""
        if self.counts[gap] and self.fits((first, gap)):
            return (gap,)
        if (a := self.pair_of(gap)) and self.fits((first, a, gap - a)):
            return (a, gap - a)
        for a in np.flatnonzero(self.counts[: max(gap - 1, 0)])[::-1].tolist():
            if a * 3 < gap:
                break
            if (b := self.pair_of(gap - a)) and self.fits((first, a, b, gap - a - b)):
                return (a, b, gap - a - b)
        return None


def packing_plan(counts: dict[int, int], capacity: int) -> list[Group]:
    """Groups (lengths in order, sequences) that use every piece once."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    groups: list[Group] = []
    if left[capacity]:
        groups.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    index = SumIndex(left)
    for first in range(capacity - 1, 0, -1):
        while left[first] and (rest := index.complement(first, capacity - first)):
            times = index.fits((first, *rest))
            for x in (first, *rest):
                left[x] -= times
            groups.append(((first, *rest), times))
    # Open sequences by gap: lists of (lengths, how many).
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(capacity, 0, -1):
        n = int(left[length])
        for gap in sorted(g for g in gaps if g >= length):
            if not n:
                break
            waiting = gaps.pop(gap)
            while waiting and n:
                lengths, times = waiting.pop()
                per = gap // length
                full = min(times, n // per)
                if full:
                    gaps.setdefault(gap - per * length, []).append(((*lengths, *[length] * per), full))
                    n -= full * per
                if full < times and n:
                    gaps.setdefault(gap - n * length, []).append(((*lengths, *[length] * n), 1))
                    full, n = full + 1, 0
                if full < times:
                    waiting.append((lengths, times - full))
            if waiting:
                gaps.setdefault(gap, []).extend(waiting)
        if n:
            per = capacity // length
            if n // per:
                gaps.setdefault(capacity - per * length, []).append(((length,) * per, n // per))
            if n % per:
                gaps.setdefault(capacity - n % per * length, []).append(((length,) * (n % per), 1))
    return groups + [g for waiting in gaps.values() for g in waiting]


def plan_slots(groups: list[Group]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The plan by (length, rank): sorted keys ``length << 40 | first rank``, and for each
    stretch of ranks its first sequence, the offset there and the first rank."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for lengths, times in groups:
        offset = 0
        for x in lengths:
            rank = used.get(x, 0)
            rows.append((x << 40 | rank, base, offset, rank))
            used[x] = rank + times
            offset += x
        base += times
    rows.sort()
    keys, sequence, offsets, ranks = (np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else ([], [], [], [])))
    return keys, sequence, offsets, ranks


def token_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of every document: id, piece, start, length, ids_crc32 and, if asked for, ids."""
    definition = docs.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer_path))
    ending = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = word_tokens(definition.value)
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for first, last in chunks(texts):
                for i, found in enumerate(encoder.encode_all(texts[first:last]), first):
                    data = found + ending
                    n = len(data) // 4
                    for k, a in enumerate(range(0, n, capacity)):
                        part = data[a * 4 : (a + capacity) * 4]
                        row.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = [
                batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
            ]
            names = ["_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema)


def packed_sequences(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Every piece of every document with its sequence and its offset there.

    A document is its token ids followed by ``end_id``; only longer ones are cut, every
    ``capacity`` tokens.  Null and empty texts are the end id alone.  Null ids and repeated
    rows are packed like others.  An empty table gives no pieces.  The offsets of a
    sequence are gapless from 0; sequence ids are numbered without meaning.
    """
    pieces = written_table(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids))
    # At most ``capacity`` rows.
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    slots = docs.sparkSession.sparkContext.broadcast(plan_slots(packing_plan(counts, capacity)))
    ranked = positions(pieces, ["length"], [F.col("_id"), F.col("piece"), F.col("ids_crc32")], "_rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sequence, offsets, ranks = slots.value
        for batch in batches:
            rank = batch.column("_rank").to_numpy() - 1
            at = np.searchsorted(keys, (batch.column("length").to_numpy() << 40) | rank, "right") - 1
            columns = [batch.column(c) for c in names]
            columns += [pa.array(sequence[at] + rank - ranks[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    names = [c for c in ranked.columns if c != "_rank"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    out = ranked.mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("_id", id_col)
