"""Vectorised word and shingle hashes, and MinHash minima, over batches of texts.

A batch of texts is one byte buffer.  Words are hashed from prefix sums of a
polynomial over its bytes, so no Python object is made per word; shingles mix the
hashes of neighbouring words.  Everything is 64 bits wide, deterministic and the
same on every worker.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Texts are taken together until a buffer holds so many bytes; a longer text is a buffer of its own.
CHUNK_BYTES = 1 << 20
#: Values permuted together (4 bytes each); a larger set is a block of its own.
MINIMA_BLOCK = 1 << 16

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0..n-1, modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        made = []
        for base in (BASE, INVERSE):
            steps = np.full(max(n, 2 * CHUNK_BYTES), base, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers = (made[0], made[1])
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: Sequence[bytes] | Sequence[str], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that fit a buffer together, by their lengths."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def run_hashes(
    values: np.ndarray, starts: np.ndarray | slice, ends: np.ndarray | slice, lengths: np.ndarray | None = None
) -> np.ndarray:
    """Hash of values[s:e] for every pair of bounds; ``lengths`` (one for all, or one each) go with slices."""
    forward, back = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * forward[: len(values)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * back[starts]
    if lengths is None:
        lengths = (ends - starts).astype(np.uint64)
    return mixed(raw + lengths * np.uint64(0xD6E8FEB86659FD93))


def words(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (maximal runs without ASCII white space) of all texts.

    Returns the hash of every word, its start and end in its own text (bytes) and
    the offsets of each text's first word, with the total at the end.
    """
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = SPACE[buffer]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begins = np.concatenate(([0], np.cumsum(lengths)))
    offsets = np.searchsorted(starts, begins)
    origin = np.repeat(begins[:-1], np.diff(offsets))
    return run_hashes(buffer, starts, ends), starts - origin, ends - origin, offsets


def word_shingles(hashes: np.ndarray, offsets: np.ndarray, k: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words inside a text, in order, and each text's offsets.

    A text with fewer words has one shingle, the whole sequence, if ``whole``.
    """
    counts = np.diff(offsets)
    full = np.maximum(counts - k + 1, 0)
    out_counts = np.where((full == 0) & (counts > 0), 1, full) if whole else full
    out = np.concatenate(([0], np.cumsum(out_counts)))
    at = np.repeat(offsets[:-1] - out[:-1], out_counts) + np.arange(out[-1])
    x = np.zeros(out[-1], np.uint64)
    used = np.repeat(np.minimum(counts, k), out_counts)
    for j in range(k):
        there = used > j
        step = mixed(x[there] * np.uint64(3) + hashes[at[there] + j])
        x[there] = step
    return x, out


def line_shingles(lines: Sequence[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` code points of every line, in order, and each line's offsets."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.fromiter((len(x) for x in lines), np.int64, len(lines))
    begins = np.concatenate(([0], np.cumsum(n)))
    counts = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    # All runs of the joined lines by neighbouring slices; those that cross a line's end are left out.
    x = np.zeros(len(codes), np.uint64)
    runs = max(len(codes) - k + 1, 0)
    x[:runs] = run_hashes(codes, slice(0, runs), slice(k, k + runs), np.full(1, k, np.uint64))
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        ends = np.cumsum(n[short])
        theirs = codes[np.repeat(begins[short] - ends + n[short], n[short]) + np.arange(ends[-1])]
        x[begins[short]] = run_hashes(theirs, ends - n[short], ends)
    filled = np.flatnonzero(n)
    step = np.zeros(len(codes) + 1, np.int8)
    step[begins[filled]] += 1
    step[begins[filled] + counts[filled]] -= 1
    return x[np.cumsum(step[:-1], dtype=np.int8).astype(bool)], np.concatenate(([0], np.cumsum(counts)))


def distinct_runs(values: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct values of every one of the neighbouring sets that ``offsets`` part."""
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        run = np.sort(values[a:b])
        first = np.ones(len(run), bool)
        np.not_equal(run[1:], run[:-1], out=first[1:])
        out.append(run[first])
    return out


def char_shingles(codes: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of the runs of ``k`` code points; of all of them, if there are fewer."""
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.uint64)
    starts = np.arange(max(1, n - k + 1))
    return np.unique(run_hashes(codes, starts, np.minimum(starts + k, n)))


class MinHash:
    """``n`` minima per set, over 32-bit multiply-add permutations."""

    def __init__(self, n: int, seed: int = 1):
        rng = np.random.RandomState(seed)
        self.n = n
        self.a = rng.randint(0, 1 << 31, n).astype(np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.randint(0, 1 << 31, n).astype(np.uint32)

    def minima(self, values: np.ndarray) -> np.ndarray:
        """Minima of one set of 64-bit hashes; all ones for the empty set."""
        best = np.full(self.n, 0xFFFFFFFF, np.uint32)
        x = (values >> np.uint64(32)).astype(np.uint32)
        for start in range(0, len(x), 2048):
            block = x[start : start + 2048, None] * self.a + self.b
            np.minimum(best, block.min(axis=0), out=best)
        return best

    def minima_of(self, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Minima of many sets that lie one after the other; values may repeat in a set.

        One permutation is applied to a whole run of sets at a time, so that every step works on
        neighbouring values of a block that stays in the cache.
        """
        out = np.full((self.n, len(offsets) - 1), 0xFFFFFFFF, np.uint32)
        x = (values >> np.uint64(32)).astype(np.uint32)
        filled = np.flatnonzero(np.diff(offsets))
        i = 0
        while i < len(filled):
            begin = offsets[filled[i]]
            j = max(i + 1, int(np.searchsorted(offsets[filled + 1], begin + MINIMA_BLOCK, "right")))
            some = filled[i:j]
            block, at = x[begin : offsets[some[-1] + 1]], offsets[some] - begin
            permuted = np.empty_like(block)
            for h in range(self.n):
                np.multiply(block, self.a[h], out=permuted)
                np.add(permuted, self.b[h], out=permuted)
                out[h, some] = np.minimum.reduceat(permuted, at)
            i = j
        return np.ascontiguousarray(out.T)


def band_keys(minima: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` minima; the band's number is part of it."""
    grid = minima.reshape(*minima.shape[:-1], -1, rows).astype(np.uint64)
    x = np.arange(grid.shape[-2], dtype=np.uint64) + np.zeros(grid.shape[:-1], np.uint64)
    for j in range(rows):
        x = mixed(x * np.uint64(3) + grid[..., j] + np.uint64(j + 1))
    return x.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of intersection and union of two sorted arrays of distinct values."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared, len(a) + len(b) - shared
