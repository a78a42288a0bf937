"""Near-duplicate passages by compact windows.

A text is a sequence of five-word shingles.  Under one hash function every shingle that is
the smallest of some stretch of ``width`` shingles has a compact window: the widest stretch
in which it is the smallest, its subtree in the Cartesian tree of the hashes.  All stretches
of the window that hold it share this minimum.  Windows of two functions that meet share
both minima; their intersection is a box with a key made of the two; boxes of one key that
overlap are one.  Documents that share a passage share the keys of its boxes, so boxes are
joined by key.  All boxes of a key are compared with its first and its last one by confirming
their segments on the shingles.  The boxes between those two are compared among themselves
inside tasks, the keys of one first holder together, block by block: the shingles of their
intervals travel, no pairs do.  A pair is looked at if the intervals share enough shingles in
some window on both sides, unless all of these lie in stretches that hang together already,
directly or through others; a key all of whose boxes lie in such stretches is done.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweir.llm.components import components
from corpusweir.llm.shingling import chunks, mixed, word_shingles, words
from corpusweir.session import bounded_broadcast, written_table

SHINGLE = 5
#: Words of the shortest passage.
PASSAGE = 50
PERCENT = 80
#: Pairs of hash functions: passages at the threshold share no key with probability (1 - 0.8^2)^7, 0.08 %.
BANDS = 7
#: Long texts are cut into segments of so many words that overlap by a passage less one word.
SEGMENT = 512
#: Occurrences on one side times those on the other from which a shingle counts as repeated.
OFTEN = 64
#: Boxes of a block; a task holds two blocks of one key at most.
BLOCK = 1024
#: Shared shingles of boxes that are counted at once.
MATCHES = 1 << 17
#: Documents whose ids and text hashes may be broadcast to fetch their texts; beyond it they are shuffled.
FETCHED = 1_000_000


def range_minima(h: np.ndarray, levels: int) -> list[np.ndarray]:
    """Minima of the 2^j values from each position on; beyond the end the largest value."""
    out = [h]
    for j in range(levels):
        shifted = np.full(len(h), np.uint64(0xFFFFFFFFFFFFFFFF))
        shifted[: max(len(h) - (1 << j), 0)] = out[-1][1 << j :]
        out.append(np.minimum(out[-1], shifted))
    return out


def extents(h: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, minima: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Subtrees of the Cartesian tree: from the last smaller or equal value before to the next smaller after."""
    left, right, value = at.copy(), at + 1, h[at]
    for j in range(len(minima) - 1, -1, -1):
        step = left - (1 << j)
        good = step >= low
        good[good] = minima[j][step[good]] > value[good]
        left[good] = step[good]
        good = right + (1 << j) <= high
        good[good] = minima[j][right[good]] >= value[good]
        right[good] += 1 << j
    return left, right


def boxes(shingles: np.ndarray, offsets: np.ndarray, width: int, bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Boxes of all segments, in order: segment, key, first shingle and the end of its stretch."""
    lengths = np.diff(offsets)
    found: list[list[np.ndarray]] = [[], [], [], []]
    if not (lengths >= width).any():
        none = np.zeros(0, np.int64)
        return none, none, none, none
    levels, reach = int(lengths.max()).bit_length(), width.bit_length() - 1
    begins = np.concatenate([np.arange(s, e - width + 1) for s, e in zip(offsets[:-1], offsets[1:], strict=True) if e - s >= width])
    segment = np.searchsorted(offsets, begins, "right") - 1
    # A value's low bits are its position, so that values differ and a minimum says where it is.
    low_bits = np.uint64((1 << len(shingles).bit_length()) - 1)
    position = np.arange(len(shingles), dtype=np.uint64)
    for band in range(bands):
        sides = []
        for f in range(2):
            h = mixed(shingles + np.uint64(0x51ED2701) * np.uint64(2 * band + f + 1))
            values = (h & ~low_bits) | position
            minima = range_minima(values, levels)
            smallest = np.minimum(minima[reach][begins], minima[reach][begins + (width - (1 << reach))])
            sides.append((h, values, minima, (smallest & low_bits).astype(np.int64)))
        moved = (np.diff(sides[0][3]) != 0) | (np.diff(sides[1][3]) != 0) | (np.diff(segment) != 0)
        fresh = np.flatnonzero(np.concatenate(([True], moved)))
        own = segment[fresh]
        low, high, key = offsets[own], offsets[own + 1], np.full(len(fresh), band, np.uint64)
        for h, values, minima, corner in sides:
            left, right = extents(values, corner[fresh], offsets[own], offsets[own + 1], minima)
            low, high = np.maximum(low, left), np.minimum(high, right)
            key = mixed(key * np.uint64(3) + h[corner[fresh]])
        for column, found_here in zip(found, (own, key.view(np.int64), low - offsets[own], high - offsets[own]), strict=True):
            column.append(found_here)
    return united(*(np.concatenate(c) for c in found))


def united(
    segment: np.ndarray, key: np.ndarray, low: np.ndarray, high: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Boxes ordered by segment and key; those of one key in a segment that overlap or touch are one.

    A shingle that follows itself is the smallest of its stretch at each of its places, so a run
    of one word has as many boxes as words, all with the same key.
    """
    order = np.argsort((segment.astype(np.uint64) << np.uint64(40)) | (key.view(np.uint64) >> np.uint64(24)), kind="stable")
    segment, key, low, high = segment[order], key[order], low[order], high[order]
    again = (np.diff(segment) == 0) & (np.diff(key) == 0)
    if not again.any():
        return segment, key, low, high
    # Only the boxes whose key comes again in their segment are put in order and united.
    some = np.flatnonzero(np.concatenate(([False], again)) | np.concatenate((again, [False])))
    group = np.cumsum(np.concatenate(([True], ~again)))[some]
    inner = np.lexsort((low[some], group))
    low[some], high[some] = low[some][inner], high[some][inner]
    base = group * (int(high.max()) + 1)
    reach = np.maximum.accumulate(base + high[some])
    joins = np.zeros(len(some), bool)
    joins[1:] = (np.diff(group) == 0) & (base[1:] + low[some][1:] <= reach[:-1])
    high[some] = reach - base
    kept = np.ones(len(key), bool)
    kept[some[joins]] = False
    # The last of those united reaches as far as all of them.
    lasts = np.flatnonzero(~np.concatenate((joins[1:], [False])))
    high[some[~joins]] = high[some[lasts]]
    return segment[kept], key[kept], low[kept], high[kept]


def segment_bounds(n: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Word ranges of a text's segments; every run of ``overlap`` + 1 words lies in one."""
    out, start = [], 0
    while True:
        end = min(n, start + size)
        out.append((start, end))
        if end == n:
            return out
        start = end - overlap


def cut(texts: list[bytes], size: int, overlap: int) -> Iterator[tuple[int, int, int, int, int, np.ndarray]]:
    """(text, segment, first word, first byte, end byte, word hashes) of all segments."""
    for a, b in chunks(texts):
        hashes, starts, ends, offsets = words(texts[a:b])
        for i in range(b - a):
            o, n = offsets[i], offsets[i + 1] - offsets[i]
            if n > overlap:
                for k, (s, e) in enumerate(segment_bounds(n, size, overlap)):
                    yield a + i, k, s, int(starts[o + s]), int(ends[o + e - 1]), hashes[o + s : o + e]


def lowered(texts: list) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]


def segments(docs: DataFrame, passage: int, bands: int) -> DataFrame:
    """``docs(_id, rid, th, text)`` as segments with fingerprint, box keys and intervals."""
    width = passage - SHINGLE + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for piece in cut(lowered(batch.column(3).to_pylist()), SEGMENT, passage - 1):
                held.append(piece)
                size += len(piece[5])
                if size > 1 << 17:
                    yield made(batch, held)
                    held, size = [], 0
            if held:
                yield made(batch, held)

    def made(batch: pa.RecordBatch, held: list[tuple]) -> pa.RecordBatch:
        row, number, first, _, _, hashes = zip(*held, strict=True)
        counts = np.array([len(h) for h in hashes])
        offsets = np.concatenate(([0], np.cumsum(counts)))
        shingles, out = word_shingles(np.concatenate(hashes), offsets, SHINGLE, whole=False)
        segment, key, low, high = boxes(shingles, out, width, bands)
        at = np.concatenate(([0], np.cumsum(np.bincount(segment, minlength=len(held))))).astype(np.int32)
        place = (low << 16 | high).astype(np.int32)
        prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(h.tobytes()) for h in hashes), np.int64).reshape(-1, 2)
        taken = batch.select([0, 1, 2]).take(pa.array(row, pa.int64()))
        return pa.RecordBatch.from_arrays(
            [
                *taken.columns, pa.array(number, pa.int32()), pa.array(first, pa.int64()), pa.array(counts),
                pa.array(prints[:, 0]), pa.array(prints[:, 1]),
                pa.ListArray.from_arrays(pa.array(at), pa.array(key)), pa.ListArray.from_arrays(pa.array(at), pa.array(place)),
            ],
            ["_id", "rid", "th", "seg", "first", "n", "f1", "f2", "keys", "places"],
        )

    kind = docs.schema["_id"].dataType.simpleString()
    schema = (
        f"_id {kind}, rid bigint, th bigint, seg int, first bigint, n bigint, f1 bigint, f2 bigint, "
        "keys array<bigint>, places array<int>"
    )
    return docs.select("_id", "rid", "th", "text").mapInArrow(run, schema)


def window_sets(x: np.ndarray, often: np.ndarray, width: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of ``x`` (numbers below ``size``) that hold a repeated shingle, and the sets in them."""
    held = np.concatenate(([0], np.cumsum(often)))
    starts = np.flatnonzero(held[width:] > held[:-width])
    sets = np.zeros((len(starts), size), np.float32)
    sets[np.repeat(np.arange(len(starts)), width), x[(starts[:, None] + np.arange(width)).ravel()]] = 1
    return starts, sets


def joined_windows(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Windows that overlap or touch as one stretch each."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.diff(starts) > width)
    return list(zip(starts[np.concatenate(([0], new + 1))].tolist(), (starts[np.concatenate((new, [-1]))] + width).tolist(), strict=True))


def repeated_runs(
    a: np.ndarray, b: np.ndarray, often_a: np.ndarray, often_b: np.ndarray, width: int, percent: int
) -> list[tuple[int, int, int, int]]:
    """Stretches that hold shingles found over and over, by the sets of their windows at every start.

    The windows of ``a`` that are similar to one of ``b``, and those of ``b``, are joined to
    stretches of their own; where there are several on a side, the others go with the first.
    """
    if min(len(a), len(b)) < width:
        return []
    known, number = np.unique(np.concatenate((a, b)), return_inverse=True)
    (at, left), (to, right) = (
        window_sets(x, often, width, len(known)) for x, often in ((number[: len(a)], often_a), (number[len(a) :], often_b))
    )
    both = left @ right.T
    close = 100 * both >= percent * (left.sum(axis=1)[:, None] + right.sum(axis=1)[None, :] - both)
    ours, theirs = joined_windows(at[close.any(axis=1)], width), joined_windows(to[close.any(axis=0)], width)
    return [(*x, *theirs[0]) for x in ours] + [(*ours[0], *y) for y in theirs[1:]]


def shared_stretches(a: np.ndarray, b: np.ndarray, width: int, percent: int) -> list[tuple[int, int, int, int]]:
    """Stretches of two shingle sequences that are similar enough: (start, end) in ``a`` and in ``b``.

    Along every diagonal with enough equal shingles, the shingles that two facing stretches
    of ``width`` share are counted for all starts at once; stretches that share enough and
    follow each other are one, and that one is confirmed on the sets.
    """
    if not len(a) or not len(b):
        return []
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    # Shingles that repeat on both sides would face each other everywhere: windows with any of them are compared as sets.
    _, back, times = np.unique(a, return_inverse=True, return_counts=True)
    often = (hi - lo) * times[back] > OFTEN
    out = repeated_runs(a, b, often, np.isin(b, a[often]), width, percent) if often.any() else []
    hi = np.where(often, lo, hi)
    p = np.repeat(np.arange(len(a)), hi - lo)
    if not len(p):
        return out
    q = order[np.repeat(lo - np.concatenate(([0], np.cumsum(hi - lo)[:-1])), hi - lo) + np.arange(len(p))]
    need = -(-2 * percent * width // (100 + percent))
    diagonals, counts = np.unique(q - p, return_counts=True)
    # The few edits that this similarity allows leave half of it on one diagonal at least.
    order = np.argsort(-counts, kind="stable")
    diagonals = diagonals[order][counts[order] >= need // 2]
    covered_a, covered_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    for d in diagonals:
        exact = q - p == d
        if covered_a[p[exact]].all() and covered_b[q[exact]].all():
            continue
        near = np.abs(q - p - d) < width
        if near.sum() < need:
            continue
        x, y = p[near], q[near]
        shift = y - d
        begin, end = np.maximum(np.maximum(x, shift) - width + 1, 0), np.minimum(x, shift) + 1
        good = begin < end
        n = len(a) + 1
        line = np.cumsum(np.bincount(begin[good], minlength=n) - np.bincount(np.minimum(end[good], len(a)), minlength=n))
        starts = np.arange(len(a))
        fits = (line[:-1] >= need) & (starts + width <= len(a)) & (starts + d >= 0) & (starts + d + width <= len(b))
        edge = np.flatnonzero(np.diff(np.concatenate(([False], fits, [False])).astype(np.int8)))
        for s, e in zip(edge[0::2], edge[1::2] - 1 + width, strict=True):
            # It begins and ends with a shared shingle.
            inside = (np.minimum(x, shift) >= s) & (np.maximum(x, shift) < e)
            s, e = int(np.minimum(x, shift)[inside].min()), int(np.maximum(x, shift)[inside].max()) + 1
            for first, last in ((s, e), (s, s + width), (e - width, e)) if e - s >= width else ():
                left, right = np.unique(a[first:last]), np.unique(b[first + d : last + d])
                both = len(np.intersect1d(left, right, assume_unique=True))
                if 100 * both >= percent * (len(left) + len(right) - both):
                    out.append((int(first), int(last), int(first + d), int(last + d)))
                    covered_a[first:last] = covered_b[first + d : last + d] = True
                    if (first, last) == (s, e):
                        break
    return out


def ranges(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, one range after the other, and the range of each."""
    n = np.maximum(end - first, 0)
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(np.arange(len(n)), n)


def straight_stretches(
    pair: np.ndarray, x: np.ndarray, y: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, width: int, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """The ``shared_stretches`` of many pairs of sequences in which no shingle comes twice: pair, and (start, end) in each.

    The shingle at ``x`` of the first is the one at ``y`` of the second sequence of ``pair``; the
    lengths of the sequences are ``n_a`` and ``n_b``.  All pairs are taken along their first
    diagonal, then along their second one, and so on.
    """
    need = -(-2 * percent * width // (100 + percent))
    reach = int(np.abs(y - x).max(initial=0)) + 1
    lines, counts = np.unique(pair * (2 * reach) + (y - x + reach), return_counts=True)
    lines, counts = lines[counts >= need // 2], counts[counts >= need // 2]
    who, diagonal = lines // (2 * reach), lines % (2 * reach) - reach
    order = np.lexsort((diagonal, -counts, who))
    who, diagonal = who[order], diagonal[order]
    rank = np.arange(len(who)) - np.searchsorted(who, who)
    start_a, start_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    covered_a, covered_b = np.zeros(n_a.sum(), bool), np.zeros(n_b.sum(), bool)
    order = np.argsort(pair * (int(n_a.max(initial=0)) + 1) + x)
    pair, x, y = pair[order], x[order], y[order]
    out: list[tuple[np.ndarray, ...]] = []
    for k in range(rank.max(initial=-1) + 1):
        rows, d = who[rank == k], diagonal[rank == k]
        number = np.full(len(n_a), -1)
        number[rows] = np.arange(len(rows))
        mine = np.flatnonzero(number[pair] >= 0)
        row, at, to = number[pair[mine]], x[mine], y[mine]
        shift = to - d[row]
        open_rows = np.zeros(len(rows), bool)
        known = covered_a[start_a[rows][row] + at] & covered_b[start_b[rows][row] + to]
        open_rows[row[(shift == at) & ~known]] = True
        near = open_rows[row] & (np.abs(shift - at) < width)
        near &= (np.bincount(row[near], minlength=len(rows)) >= need)[row]
        if not near.any():
            continue
        whose, lo, hi = row[near], np.minimum(at, shift)[near], np.maximum(at, shift)[near]
        begin, end = np.maximum(hi - width + 1, 0), lo + 1
        good = begin < end
        # One place for every start, and one behind them, for each row.
        n, m = n_a[rows], n_b[rows]
        origin = np.cumsum(n + 1) - n - 1
        size = int((n + 1).sum())
        line = np.cumsum(
            np.bincount(origin[whose[good]] + begin[good], minlength=size)
            - np.bincount(origin[whose[good]] + np.minimum(end[good], n[whose[good]]), minlength=size)
        )
        starts, of = ranges(np.zeros(len(n), np.int64), n + 1)
        fits = (line >= need) & (starts + width <= n[of]) & (starts + d[of] >= 0) & (starts + d[of] + width <= m[of])
        edge = np.flatnonzero(np.diff(np.concatenate(([False], fits, [False])).astype(np.int8)))
        held, s, e = of[edge[0::2]], starts[edge[0::2]], starts[edge[1::2] - 1] + width
        if not len(s):
            continue
        # It begins and ends with a shared shingle.
        step = int(n.max()) + width + 1
        order = np.argsort(whose * step + lo, kind="stable")
        lo, hi, key = lo[order], hi[order], (whose * step + lo)[order]
        some, stretch = ranges(np.searchsorted(key, held * step + s), np.searchsorted(key, held * step + e))
        inside = hi[some] < e[stretch]
        heads = np.searchsorted(stretch, np.arange(len(s)))
        s = np.minimum.reduceat(np.where(inside, lo[some], step), heads)
        e = np.maximum.reduceat(np.where(inside, hi[some], -1), heads) + 1
        long = e - s >= width
        held, s, e = held[long], s[long], e[long]
        key = row * step + at

        def alike(held: np.ndarray, s: np.ndarray, e: np.ndarray, d=d, key=key, to=to, step=step) -> np.ndarray:
            some, stretch = ranges(np.searchsorted(key, held * step + s), np.searchsorted(key, held * step + e))
            shift = to[some] - d[held][stretch]
            both = np.bincount(stretch[(shift >= s[stretch]) & (shift < e[stretch])], minlength=len(s))
            return 100 * both >= percent * (2 * (e - s) - both)

        whole = alike(held, s, e)
        tried = [(held[whole], s[whole], e[whole])]
        held, s, e = held[~whole], s[~whole], e[~whole]
        for first, last in ((s, s + width), (e - width, e)):
            good = alike(held, first, last)
            tried.append((held[good], first[good], last[good]))
        held, s, e = (np.concatenate(c) for c in zip(*tried, strict=True))
        d = d[held]
        covered_a[ranges(start_a[rows][held] + s, start_a[rows][held] + e)[0]] = True
        covered_b[ranges(start_b[rows][held] + s + d, start_b[rows][held] + e + d)[0]] = True
        out.append((rows[held], s, e, s + d, e + d))
    found = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
    order = np.argsort(found[0], kind="stable")
    return found[0][order], np.stack(found[1:], axis=1)[order]


def stretches_of(values: np.ndarray, out: np.ndarray, width: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """``shared_stretches`` of pairs of sequences: the first ones lie before the second ones in ``values``, by ``out``."""
    n = np.diff(out)
    pairs = len(n) // 2
    of = np.repeat(np.arange(2 * pairs), n)
    place, pair = np.arange(len(values)) - out[of], of % pairs if pairs else of
    named = mixed(values ^ mixed(pair.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(named, kind="stable")
    equal = np.flatnonzero((named[order][1:] == named[order][:-1]) & (pair[order][1:] == pair[order][:-1]))
    left, right = order[equal], order[equal + 1]
    twice = np.zeros(pairs, bool)
    twice[pair[left[of[left] == of[right]]]] = True
    straight = ~twice[pair[left]]
    left, right = left[straight], right[straight]
    row, found = straight_stretches(pair[left], place[left], place[right], n[:pairs], n[pairs:], width, percent)
    rows, every = [row], [found]
    for k in np.flatnonzero(twice).tolist():
        stretches = shared_stretches(values[out[k] : out[k + 1]], values[out[k + pairs] : out[k + pairs + 1]], width, percent)
        rows.append(np.full(len(stretches), k))
        every.append(np.array(stretches, np.int64).reshape(-1, 4))
    return np.concatenate(rows), np.concatenate(every)


def confirmed(pairs: DataFrame, texts: DataFrame, passage: int, percent: int) -> DataFrame:
    """Pairs of segments with the stretches, in words, that they share."""
    width = passage - SHINGLE + 1
    sided = pairs
    for side in "ab":
        sided = sided.join(
            texts.select(F.col("rid").alias(f"r{side}"), F.col("seg").alias(f"s{side}"), F.col("part").alias(f"_t{side}")),
            [f"r{side}", f"s{side}"],
        )
    sided = sided.select("ra", "sa", "rb", "sb", "_ta", "_tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                data = part.column(4).to_pylist() + part.column(5).to_pylist()
                hashes, _, _, offsets = words(data)
                shingles, out = word_shingles(hashes, offsets, SHINGLE, whole=False)
                row, stretches = stretches_of(shingles, out, width, percent)
                stretches[:, 1::2] += SHINGLE - 1
                taken = part.select([0, 1, 2, 3]).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, *[pa.array(stretches[:, c]) for c in range(4)]],
                    ["ra", "sa", "rb", "sb", "a_start", "a_end", "b_start", "b_end"],
                )

    return sided.mapInArrow(run, "ra bigint, sa int, rb bigint, sb int, a_start bigint, a_end bigint, b_start bigint, b_end bigint")


def box_shingles(asked: DataFrame) -> DataFrame:
    """``asked(rid, seg, part, boxes, runs)`` as a row per box: 31 bits of each shingle, and start, end and class of the ``runs`` in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                hashes, _, _, offsets = words(part.column(2).to_pylist())
                shingles, out = word_shingles(hashes, offsets, SHINGLE, whole=False)
                row: list[int] = []
                made: list[tuple] = []
                for k, (boxes_here, runs) in enumerate(zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)):
                    short = (shingles[out[k] : out[k + 1]] >> np.uint64(33)).astype(np.uint32)
                    known = np.array([(r["s"], r["e"], r["root"]) for r in runs or ()], np.int64).reshape(-1, 3)
                    for box in boxes_here:
                        low, high = box["low"], box["high"]
                        inside = known[(known[:, 0] < high) & (known[:, 1] > low)]
                        inside[:, :2] = np.clip(inside[:, :2], low, high) - low
                        row.append(k)
                        made.append((box["key"], box["blocks"], short[low:high].tobytes(), inside.tobytes()))
                taken = part.select([0, 1]).take(pa.array(row, pa.int64()))
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
                columns = [pa.array([m[c] for m in made], kind) for c, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*taken.columns, *columns], ["rid", "seg", "key", "blocks", "shingles", "runs"])

    return asked.select("rid", "seg", "part", "boxes", "runs").mapInArrow(
        run, "rid bigint, seg int, key bigint, blocks int, shingles binary, runs binary"
    )


def classes_of(sets: list[np.ndarray], runs: list[np.ndarray]) -> list[np.ndarray]:
    """The class of every shingle, from 1, by the ``runs(start, end, class)`` of its box; 0 outside of them."""
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    marks = np.zeros(offsets[-1], np.int64)
    every = np.concatenate(runs)
    length = every[:, 1] - every[:, 0]
    first = np.repeat(offsets[:-1], [len(r) for r in runs]) + every[:, 0]
    inside = np.repeat(first - np.cumsum(length) + length, length) + np.arange(length.sum())
    marks[inside] = np.repeat(np.unique(every[:, 2], return_inverse=True)[1] + 1, length)
    return [marks[s:e] for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


class Boxes:
    """Boxes of one or more keys with the classes of their shingles; pairs are made of one key's.

    A shingle of a box is one entry, wherever it stands in it.  The entries of a shingle and key lie
    side by side, so those that later boxes share with one are found without looking at pairs.
    """

    def __init__(self, key: np.ndarray, sets: list[np.ndarray], done: list[np.ndarray], width: int, percent: int):
        self.sets, self.width, self.percent = sets, width, percent
        self.lengths = np.array([len(x) for x in sets])
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)))
        self.marks = np.concatenate(done)
        self.fresh = int(self.marks.max(initial=0)) + 1
        box = np.repeat(np.arange(len(sets)), self.lengths)
        named = key[box].astype(np.uint64) << np.uint64(32) | np.concatenate(sets).astype(np.uint64)
        order = np.argsort(named, kind="stable")
        named, box = named[order], box[order]
        token = np.concatenate(([True], named[1:] != named[:-1]))
        first = token | np.concatenate(([True], box[1:] != box[:-1]))
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(first) - 1
        self.owner, self.place = box[first], order[first]
        token = np.flatnonzero(token[first])
        ends = np.concatenate((token[1:], [len(self.owner)]))
        #: Entries behind each one that stand for the same shingle in later boxes.
        self.behind = np.repeat(ends, ends - token) - np.arange(len(self.owner)) - 1
        self.again = np.bincount(self.entry, minlength=len(self.owner)) > 1
        self.by_box = np.argsort(self.owner, kind="stable")
        self.places = np.searchsorted(self.owner[self.by_box], np.arange(len(sets) + 1))
        self.floor = np.full(len(sets), width)
        self._least_distinct(order, first)
        self.held = self.marks[self.place]
        self.held[self.entry[self.held[self.entry] != self.marks]] = 0
        lasts = np.searchsorted(key, key, "right")
        self.later = lasts - np.arange(len(sets)) - 1

    def _least_distinct(self, order: np.ndarray, first: np.ndarray) -> None:
        """The fewest different shingles of any window of each box; ``order`` has those of an entry side by side."""
        again = np.flatnonzero(~first)
        if not len(again):
            return
        some = np.unique(np.searchsorted(self.offsets, order[again], "right") - 1)
        # A shingle counts in the windows that begin behind the one before it, or a width before its end.
        begin = np.arange(len(order)) - self.width + 1
        begin[order[again]] = np.maximum(begin[order[again]], order[again - 1] + 1)
        begin = np.maximum(begin, np.repeat(self.offsets[:-1], self.lengths))
        counts = np.cumsum(np.bincount(begin, minlength=len(order) + 1) - np.bincount(np.arange(1, len(order) + 1), minlength=len(order) + 1))
        for i in some.tolist():
            windows = counts[self.offsets[i] : self.offsets[i + 1] - self.width + 1]
            self.floor[i] = windows.min() if len(windows) else 1

    def part(self, i: int) -> np.ndarray:
        """The classes of a box, to be read and set."""
        return self.marks[self.offsets[i] : self.offsets[i + 1]]

    def note(self, i: int) -> None:
        """The class of a box's entries, 0 if its shingle stands in several."""
        mine = self.entry[self.offsets[i] : self.offsets[i + 1]]
        self.held[mine] = self.part(i)
        self.held[mine[self.held[mine] != self.part(i)]] = 0

    def parts(self) -> Iterator[tuple[int, int]]:
        """Ranges of boxes that have up to MATCHES entries, and later boxes, behind them; a box with more is alone."""
        behind = np.bincount(self.owner, self.behind, len(self.sets)).astype(np.int64)
        load = np.concatenate(([0], np.cumsum(np.maximum(behind, self.later))))
        a = 0
        while a < len(self.sets):
            b = max(a + 1, int(np.searchsorted(load, load[a] + MATCHES, "right")) - 1)
            yield a, b
            a = b

    def news(self, a: int, b: int, fits: Callable) -> Iterator[tuple[int, int, list]]:
        """What is shared by pairs of the boxes ``a`` to ``b`` and later ones, if it may not hang together already."""
        own = self.by_box[self.places[a] : self.places[b]]
        own = own[self.behind[own] > 0]
        n = self.behind[own]
        if not len(own):
            return
        n = n.astype(np.int32)
        met = np.repeat(own.astype(np.int32) + 1 - np.cumsum(n, dtype=np.int32) + n, n) + np.arange(n.sum(), dtype=np.int32)
        later = self.later[a:b]
        base = np.cumsum(later) - later
        pair = np.repeat((base - np.arange(a, b) - 1)[self.owner[own] - a].astype(np.int32), n) + self.owner[met]
        shared = np.bincount(pair, minlength=later.sum())
        some = np.flatnonzero(shared)
        i = np.repeat(np.arange(a, b), later)[some]
        j = some - base[i - a] + i + 1
        # Two similar windows of so many different shingles share at least that many.
        close = (shared[some] * (100 + self.percent) >= self.percent * (self.floor[i] + self.floor[j])) & fits(i, j)
        some, i, j = some[close], i[close], j[close]
        number = np.full(len(shared), -1, np.int32)
        number[some] = np.arange(len(some))
        pair = number[pair]
        mine = np.flatnonzero(pair >= 0)
        pair, own, met = pair[mine], np.repeat(own.astype(np.int32), n)[mine], met[mine]
        ours, theirs = self.held[own], self.held[met]
        apart = np.zeros(len(some), bool)
        apart[pair[(ours != theirs) | (ours == 0)]] = True
        kind = np.zeros(len(some), self.held.dtype)
        kind[pair] = ours
        apart[pair[ours != kind[pair]]] = True
        number = np.cumsum(apart) - 1
        mine = np.flatnonzero(apart[pair])
        i, j, pair, own, met = i[apart], j[apart], number[pair[mine]], own[mine], met[mine]
        some = self.open_windows(i, j, pair, own, met)
        number = np.cumsum(some) - 1
        mine = np.flatnonzero(some[pair])
        yield from self.stretches(i[some], j[some], number[pair[mine]], own[mine], met[mine])

    def open_windows(self, i: np.ndarray, j: np.ndarray, pair: np.ndarray, own: np.ndarray, met: np.ndarray) -> np.ndarray:
        """Which pairs have windows with enough shared shingles which are not all of one class.

        ``pair`` numbers the pair of each two shared entries ``own`` and ``met``.  A stretch is made of
        such windows on both sides.  Where a shared shingle comes twice in a box, the pair stays.
        """
        need = -(-2 * self.percent * self.width // (100 + self.percent))
        # Shingles are of one class if the marks do not change from the first to the last.
        changes = np.concatenate(([0], np.cumsum(self.marks[1:] != self.marks[:-1])))
        kind, news = np.zeros(len(i), np.int64), np.zeros(len(i), bool)
        both, twice = np.ones(len(i), bool), np.zeros(len(i), bool)
        twice[pair[self.again[own] | self.again[met]]] = True
        counts = np.bincount(pair, minlength=len(i))
        for boxes, entries in ((i, own), (j, met)):
            # The shared places of each pair, in order.
            start = np.cumsum(self.lengths[boxes]) - self.lengths[boxes]
            there = np.zeros(start[-1] + self.lengths[boxes[-1]] if len(boxes) else 0, bool)
            there[self.place[entries] + (start - self.offsets[boxes])[pair]] = True
            whose = np.repeat(np.arange(len(i)), counts)
            place = np.flatnonzero(there) + (self.offsets[boxes] - start)[whose]
            # Of so many shared shingles of a window, the last one is less than a width behind the first.
            runs = max(len(place) - need + 1, 0)
            first = np.flatnonzero((whose[need - 1 :] == whose[:runs]) & (place[need - 1 :] - place[:runs] < self.width))
            whose, first, last = whose[first], place[first], place[first + need - 1]
            value = np.where(changes[first] == changes[last], self.marks[first], 0)
            has = np.zeros(len(i), bool)
            has[whose] = True
            both &= has
            known = kind[whose] > 0
            kind[whose[~known]] = value[~known]
            news[whose[(value == 0) | (value != kind[whose])]] = True
        return twice | (both & news)

    def stretches(self, i: np.ndarray, j: np.ndarray, pair: np.ndarray, own: np.ndarray, met: np.ndarray) -> Iterator[tuple[int, int, list]]:
        """The pairs and what they share, in order."""
        straight = (self.lengths[i] == np.diff(self.places)[i]) & (self.lengths[j] == np.diff(self.places)[j])
        number = np.cumsum(straight) - 1
        mine = straight[pair]
        pair, own, met = pair[mine], own[mine], met[mine]
        row, found = straight_stretches(
            number[pair], self.place[own] - self.offsets[i[pair]], self.place[met] - self.offsets[j[pair]],
            self.lengths[i[straight]], self.lengths[j[straight]], self.width, self.percent,
        )
        edges = np.searchsorted(row, np.arange(straight.sum() + 1)).tolist()
        for one, other, is_straight, k in zip(i.tolist(), j.tolist(), straight.tolist(), number.tolist(), strict=True):
            if is_straight:
                yield one, other, found[edges[k] : edges[k + 1]].tolist()
            else:
                yield one, other, shared_stretches(self.sets[one], self.sets[other], self.width, self.percent)

    def link(self, i: int, j: int, stretches: list) -> bool:
        """Gives what a pair of boxes shares one class; true if there is a stretch that did not hang together."""
        changed = False
        for s, e, f, g in stretches:
            one, other = self.part(i)[s:e], self.part(j)[f:g]
            known = np.unique(np.concatenate((one, other)))
            if len(known) == 1 and known[0]:
                continue
            changed = True
            known = known[known > 0]
            name = int(known[0]) if len(known) else self.fresh
            self.fresh += not len(known)
            for old in known[1:].tolist():
                self.marks[self.marks == old] = name
                self.held[self.held == old] = name
            one[:] = name
            other[:] = name
        if changed:
            self.note(i)
            self.note(j)
        return changed


def joined_boxes(
    rid: np.ndarray, second: np.ndarray, sets: list[np.ndarray], done: list[np.ndarray], width: int, percent: int,
    key: np.ndarray | None = None, across: np.ndarray | None = None,
) -> list[tuple[int, int]]:
    """Pairs of boxes of different rows with a stretch in common that does not hang together already.

    ``key`` numbers the boxes' keys in ascending order, if there are several; only boxes of one key
    make pairs.  ``second`` tells the boxes of the other block, if there is one: pairs then have one
    of each, or do so where ``across`` says it.  ``done`` holds the classes of the shingles inside
    confirmed stretches, 0 outside.  Each box leads once and meets the later ones that share enough
    shingles, unless all they share lies in one class on both sides: stretches of one class are
    linked, directly or through others.
    """
    if not sum(len(x) for x in sets):
        return []
    boxes_here = Boxes(np.zeros(len(sets), np.int64) if key is None else key, sets, done, width, percent)
    if across is None:
        across = np.full(len(sets), second.any())
    found: list[tuple[int, int]] = []

    def fits(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (rid[i] != rid[j]) & ~(across[i] & (second[i] == second[j]))

    for a, b in boxes_here.parts():
        for i, j, stretches in boxes_here.news(a, b, fits):
            if boxes_here.link(i, j, stretches):
                found.append((i, j))
    return found


def block_pairs(blocks: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs of segments found in the blocks ``(key, first, second, block, rid, seg, shingles, runs)`` that share a stretch."""
    names = ["key", "first", "second"]

    def edges_of(rows: pa.Table) -> np.ndarray:
        ids = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in range(3)])
        return np.concatenate(([0], np.flatnonzero((np.diff(ids, axis=1) != 0).any(axis=0)) + 1, [rows.num_rows]))

    def pairs_of(rows: pa.Table, key: np.ndarray) -> pa.RecordBatch:
        one, other, block, rid, seg = (rows.column(c).to_numpy() for c in ("first", "second", "block", "rid", "seg"))
        sets = [np.frombuffer(x, np.uint32) for x in rows.column("shingles").to_pylist()]
        done = classes_of(sets, [np.frombuffer(x, np.int64).reshape(-1, 3) for x in rows.column("runs").to_pylist()])
        found = joined_boxes(rid, block != one, sets, done, width, percent, key, one != other)
        ordered = [(i, j) if rid[i] < rid[j] else (j, i) for i, j in found]
        a, b = (np.array([x[k] for x in ordered], np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (rid[a], seg[a], rid[b], seg[b])], ["ra", "sa", "rb", "sb"])

    def pieces(rows: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole blocks together, up to some boxes."""
        k = 0
        while k < len(edges) - 1:
            to = max(k + 1, int(np.searchsorted(edges, edges[k] + BLOCK, "right")) - 1)
            some = rows.slice(edges[k], edges[to] - edges[k])
            yield pairs_of(some, np.repeat(np.arange(to - k), np.diff(edges[k : to + 1])))
            k = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*held, batch])
            edges = edges_of(rows)
            # The last block may go on in the next batch.
            yield from pieces(rows, edges[:-1])
            held = rows.slice(edges[-2]).to_batches()
        if held:
            rows = pa.Table.from_batches(held)
            yield from pieces(rows, edges_of(rows))

    sorted_blocks = blocks.select(*names, "block", "rid", "seg", "shingles", "runs").repartition(*names).sortWithinPartitions(*names)
    return sorted_blocks.mapInArrow(run, "ra bigint, sa int, rb bigint, sb int")


def repeated_passages(
    docs: DataFrame, passage: int = PASSAGE, percent: int = PERCENT, bands: int = BANDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Passages that occur, nearly the same, in another row: ``id_col``, start_word, end_word, first_id, first_copy.

    A passage has at least ``passage`` words (runs without ASCII white space, A-Z lowered);
    two are nearly the same from ``percent`` % Jaccard similarity of their five-word shingles
    on.  Overlapping passages of a row are one row of the result, ``end_word`` exclusive;
    ``first_id`` is the smallest id among all passages that hang together, through others or
    directly, and ``first_copy`` is true for exactly one of these: the first one in the first
    row of that id.  Rows without such a passage do not appear.  Null, empty and shorter texts
    have none; null ids take part and come last; equal rows are copies of each other.  All
    rows that share a key are compared as far as they may share a stretch that does not hang
    together through others already.
    """
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    numbered = narrow.withColumn("rid", F.monotonically_increasing_id())
    cutout = written_table(segments(numbered, passage, bands))
    # Equal segments are one; their rows repeat each other from end to end.
    classes = written_table(
        cutout.groupBy("f1", "f2", "n").agg(
            F.min(F.struct("rid", "seg")).alias("rep"), F.min("rid").alias("_low"), F.max("rid").alias("_high"), F.min("_id").alias("_least"),
            F.count("*").alias("_several"),
        )
    )
    extra = cutout.select("rid", "seg", "f1", "f2", "n").join(classes.filter("_several > 1").select("f1", "f2", "n", "rep"), ["f1", "f2", "n"])
    extra = written_table(extra.filter("rid <> rep.rid or seg <> rep.seg").select("rid", "seg"))
    rows = cutout.join(bounded_broadcast(extra, FETCHED), ["rid", "seg"], "left_anti").select(
        "rid", "seg", F.explode(F.arrays_zip("keys", "places")).alias("b")
    ).select(
        F.col("b.keys").alias("key"), "rid", F.shiftleft(F.col("seg").cast("long"), 32).bitwiseOR(F.col("b.places").cast("long")).alias("place")
    )
    # Most keys are those of one row: they are dropped in the one shuffle of all boxes.
    together = Window.partitionBy("key")
    rows = written_table(
        rows.select("key", "rid", "place", (F.min("rid").over(together) < F.max("rid").over(together)).alias("_keep")).filter("_keep").drop("_keep")
    )
    holder = F.struct("rid", "place")
    ends = rows.groupBy("key").agg(F.min(holder).alias("low"), F.max(holder).alias("high"))
    shared = written_table(rows.join(ends, "key"))
    against = F.explode(F.array("low", "high")).alias("o")
    pairs = shared.select("rid", "place", against).filter("rid <> o.rid").select(*_ordered("rid", "place", "o.rid", "o.place"))
    joined = written_table(pairs.distinct())
    texts = _texts(joined, cutout, narrow, passage)
    found = written_table(confirmed(joined, texts, passage, percent))
    more = written_table(_between(shared, found, texts, passage, percent).join(joined, ["ra", "sa", "rb", "sb"], "left_anti"))
    return _merged(found.union(confirmed(more, texts, passage, percent)), cutout, classes, id_col)


def _between(shared: DataFrame, found: DataFrame, texts: DataFrame, passage: int, percent: int) -> DataFrame:
    """Pairs of segments among the boxes between the first and the last of their key."""
    seg = F.shiftright("place", 32).cast("int").alias("seg")
    low, high = (F.shiftright("place", by).bitwiseAND(F.lit(0xFFFF)).cast("int") for by in (16, 0))
    at_end = [(F.col("rid") == F.col(f"{x}.rid")) & (F.col("place") == F.col(f"{x}.place")) for x in ("low", "high")]
    lead = F.xxhash64("low.rid", F.shiftright("low.place", 32)).alias("lead")
    middle = shared.filter(~at_end[0] & ~at_end[1]).select("key", "rid", seg, low.alias("low"), high.alias("high"), lead)
    runs = written_table(_runs(found).groupBy("rid", "seg").agg(F.collect_list(F.struct("s", "e", "root")).alias("runs")))
    # A box inside one run has its class; any other is open.
    around = F.filter("runs", lambda x: (x["s"] <= F.col("low")) & (x["e"] >= F.col("high")))
    marked = middle.join(runs, ["rid", "seg"], "left").withColumn("root", F.get(around, F.lit(0))["root"])
    keys = marked.groupBy("key").agg(
        F.min("rid").alias("_low"), F.max("rid").alias("_high"), F.max(F.col("root").isNull()).alias("_open"),
        (F.min("root") < F.max("root")).alias("_apart"),
    ).filter("_low < _high and (_open or _apart)").select("key")
    # The keys of one first holder are taken together: their boxes in a segment are one, and two segments meet once under all of them.
    boxed = written_table(
        middle.join(keys, "key").groupBy("lead", "rid", "seg").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    )
    sizes = boxed.groupBy("lead").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    boxed = boxed.join(sizes, "lead").groupBy("rid", "seg").agg(F.collect_list(F.struct(F.col("lead").alias("key"), "blocks", "low", "high")).alias("boxes"))
    each = box_shingles(boxed.join(texts, ["rid", "seg"]).join(runs, ["rid", "seg"], "left"))
    salted = each.withColumn("block", F.expr("cast(pmod(xxhash64(rid, seg), blocks) as int)")).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    blocks = salted.withColumn("first", F.least("block", "_other")).withColumn("second", F.greatest("block", "_other"))
    return block_pairs(blocks, passage - SHINGLE + 1, percent).distinct()


def _runs(found: DataFrame) -> DataFrame:
    """``(rid, seg, s, e, root)``: confirmed stretches of a segment that overlap, in shingles, as one; those that hang together have one root."""
    met = found.withColumn("_pair", F.xxhash64("ra", "sa", "rb", "sb", "a_start", "a_end", "b_start", "b_end"))
    sides = [
        met.select(
            "_pair", F.col(f"r{x}").alias("rid"), F.col(f"s{x}").alias("seg"), F.col(f"{x}_start").cast("int").alias("s"),
            (F.col(f"{x}_end") - (SHINGLE - 1)).cast("int").alias("e"),
        )
        for x in "ab"
    ]
    order = Window.partitionBy("rid", "seg").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = sides[0].union(sides[1]).withColumn("_new", F.coalesce((F.col("s") >= reach).cast("int"), F.lit(1)))
    numbered = opened.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stretches = written_table(numbered.withColumn("run", F.xxhash64("rid", "seg", "_run")))
    roots = components(stretches.groupBy("_pair").agg(F.min("run").alias("a"), F.max("run").alias("b")))
    merged = stretches.groupBy("rid", "seg", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return merged.join(roots.withColumnRenamed("id", "run"), "run", "left").select("rid", "seg", "s", "e", F.coalesce("root", "run").alias("root"))


def _ordered(rid: str, place: str, other_rid: str, other_place: str) -> list[Column]:
    """A pair of segments, the one of the smaller row first."""
    swap = F.col(rid) > F.col(other_rid)
    seg, other = (F.shiftright(F.col(p), 32).cast("int") for p in (place, other_place))
    return [
        F.when(swap, F.col(other_rid)).otherwise(F.col(rid)).alias("ra"), F.when(swap, other).otherwise(seg).alias("sa"),
        F.when(swap, F.col(rid)).otherwise(F.col(other_rid)).alias("rb"), F.when(swap, seg).otherwise(other).alias("sb"),
    ]


def _texts(pairs: DataFrame, cutout: DataFrame, narrow: DataFrame, passage: int) -> DataFrame:
    """``(rid, seg, part)``: the text of every segment that a pair names."""
    wanted = written_table(
        pairs.select(F.explode(F.array(F.struct(F.col("ra").alias("rid"), F.col("sa").alias("seg")), F.struct(F.col("rb").alias("rid"), F.col("sb").alias("seg")))).alias("e"))
        .select("e.rid", "e.seg").distinct().join(cutout.select("_id", "rid", "th", "seg"), ["rid", "seg"])
    )
    docs = bounded_broadcast(wanted.select(F.col("_id").alias("_wid"), F.col("th").alias("_wth")).distinct(), FETCHED)
    needed = narrow.join(docs, narrow["_id"].eqNullSafe(docs["_wid"]) & (narrow["th"] == docs["_wth"]), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = lowered(batch.column(2).to_pylist())
            row, number, part = [], [], []
            for i, k, _, begin, end, _ in cut(texts, SEGMENT, passage - 1):
                row.append(i)
                number.append(k)
                part.append(texts[i][begin:end])
            taken = batch.select([0, 1]).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(number, pa.int32()), pa.array(part, pa.binary())], ["_id", "th", "seg", "part"]
            )

    kind = narrow.schema["_id"].dataType.simpleString()
    parts = needed.select("_id", "th", "text").mapInArrow(run, f"_id {kind}, th bigint, seg int, part binary")
    met = wanted.join(parts, wanted["_id"].eqNullSafe(parts["_id"]) & (wanted["th"] == parts["th"]) & (wanted["seg"] == parts["seg"]))
    return written_table(met.select(wanted["rid"], wanted["seg"], "part").dropDuplicates(["rid", "seg"]))


def _merged(passages: DataFrame, cutout: DataFrame, classes: DataFrame, id_col: str) -> DataFrame:
    """Passages of representatives and equal segments as merged word ranges of every row."""
    rep = classes.select(F.col("rep.rid").alias("rid"), F.col("rep.seg").alias("seg"), "f1", "f2", "n")
    node = F.xxhash64("f1", "f2", "n", "s", "e")
    met = passages.withColumn("_pair", F.monotonically_increasing_id())
    sides = [
        met.select("_pair", F.col(f"r{x}").alias("rid"), F.col(f"s{x}").alias("seg"), F.col(f"{x}_start").alias("s"), F.col(f"{x}_end").alias("e"))
        .join(rep, ["rid", "seg"]).select("_pair", "f1", "f2", "n", "s", "e", node.alias("node"))
        for x in "ab"
    ]
    near = written_table(sides[0].union(sides[1]))
    whole = classes.filter("_low < _high").select("f1", "f2", "n", F.lit(0).cast("long").alias("s"), F.col("n").alias("e"))
    spans = near.select("f1", "f2", "n", "s", "e").union(whole).distinct().join(cutout.select("_id", "rid", "first", "f1", "f2", "n"), ["f1", "f2", "n"]).select(
        "_id", "rid", (F.col("first") + F.col("s")).alias("s"), (F.col("first") + F.col("e")).alias("e"), node.alias("node")
    )
    order = Window.partitionBy("rid").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("_new", F.coalesce((F.col("s") > reach).cast("int"), F.lit(1)))
    numbered = opened.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # A merged passage hangs together with the stretches it is made of, and these in pairs.
    runs = written_table(numbered.withColumn("run", F.xxhash64(F.lit("run"), "rid", "_run")))
    pairs = near.groupBy("_pair").agg(F.min("node").alias("a"), F.max("node").alias("b")).select("a", "b")
    roots = components(pairs.union(runs.select("run", "node")))
    found = runs.groupBy("_id", "rid", "run").agg(F.min("s").alias("s"), F.max("e").alias("e")).join(
        roots.withColumnRenamed("id", "run"), "run", "left"
    ).withColumn("_root", F.coalesce("root", "run")).withColumn("_place", F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), "rid", "s"))
    found = written_table(found)
    first = found.groupBy("_root").agg(F.min("_place").alias("_first"))
    return found.join(first, "_root").select(
        F.col("_id").alias(id_col), F.col("s").alias("start_word"), F.col("e").alias("end_word"),
        F.col("_first.id").alias("first_id"), (F.col("_place") == F.col("_first")).alias("first_copy"),
    )
