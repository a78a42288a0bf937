"""Batches of sets and lines give what one set or line at a time gives."""

from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusweir.llm.shingling import MINIMA_BLOCK, MinHash, char_shingles, line_shingles

LINES = st.lists(st.text("ab c€\U0001f600", max_size=12), max_size=10)


@settings(max_examples=150, deadline=None)
@given(LINES, st.sampled_from([1, 3, 5]))
def test_lines_together_and_alone(lines, k):
    shingles, offsets = line_shingles(lines, k)
    assert len(offsets) == len(lines) + 1 and offsets[-1] == len(shingles)
    for i, line in enumerate(lines):
        own = char_shingles(np.frombuffer(line.encode("utf-32-le"), np.uint32), k)
        assert np.array_equal(np.unique(shingles[offsets[i] : offsets[i + 1]]), own)


def test_minima_of_many_sets():
    rng = np.random.RandomState(7)
    sizes = [0, 1, 5, 0, 3000, MINIMA_BLOCK + 10, 2, MINIMA_BLOCK - 1, 1, 0]
    sets = [rng.randint(0, 1 << 62, n).astype(np.uint64) for n in sizes]
    minhash = MinHash(64)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    many = minhash.minima_of(np.concatenate(sets), offsets)
    x = [(s >> np.uint64(32)).astype(np.uint32) for s in sets]
    for i, values in enumerate(x):
        for h in range(minhash.n):
            permuted = values * minhash.a[h] + minhash.b[h]
            assert many[i, h] == (permuted.min() if len(values) else 0xFFFFFFFF)
        assert np.array_equal(many[i], minhash.minima(sets[i]))
    assert minhash.minima_of(np.zeros(0, np.uint64), np.zeros(1, np.int64)).shape == (0, 64)
