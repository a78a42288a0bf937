"""Steps of the comparison of passages beside plain Python."""

import numpy as np

from corpusweir.llm import passages


def test_a_run_of_one_word_has_one_box_per_key():
    r = np.random.RandomState(3)
    x = np.concatenate((r.randint(0, 1 << 62, 60), np.full(300, 7), r.randint(0, 1 << 62, 60))).astype(np.uint64)
    segment, key, low, high = passages.boxes(np.concatenate((x, x)), np.array([0, 420, 840]), 46, 7)
    assert len(key) == len(set(zip(segment.tolist(), key.tolist(), strict=True))) < 300
    assert ((low <= 60) & (high >= 360)).sum() >= 14
    assert (np.diff(segment) >= 0).all() and (high - low >= 46).all()


def test_boxes_of_a_key_that_overlap_are_united():
    r = np.random.RandomState(4)
    for _ in range(60):
        n = r.randint(1, 80)
        segment, key, low = r.randint(0, 4, n), r.randint(-3, 3, n) << 60, r.randint(0, 60, n)
        high = low + r.randint(1, 12, n)
        want = []
        for name in sorted(set(zip(segment.tolist(), key.tolist(), strict=True))):
            for a, b in sorted((a, b) for s, k, a, b in zip(segment, key, low, high, strict=True) if (s, k) == name):
                if want and want[-1][0] == name and a <= want[-1][2]:
                    want[-1][2] = max(want[-1][2], b)
                else:
                    want.append([name, a, b])
        got = passages.united(segment, key, low.copy(), high.copy())
        assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted((*name, a, b) for name, a, b in want)


def edited(r, x, rate):
    """``x`` with items changed, left out and put in, from anywhere, perhaps with its parts exchanged."""
    out = []
    for v in x[r.randint(0, 150) : len(x) - r.randint(0, 150)].tolist():
        u = r.rand()
        out += [] if u < rate / 2 else [r.randint(1 << 62)] if u < rate else [v, r.randint(1 << 62)] if u < rate * 1.5 else [v]
    cut = r.randint(0, len(out)) if out and r.rand() < 0.3 else 0
    return np.array(out[cut:] + out[:cut], np.uint64)


def test_stretches_of_many_pairs_as_one_by_one():
    for seed in range(30):
        r = np.random.RandomState(seed)
        sides = [], []
        for k in range(12):
            base = r.randint(0, 60, 300) if k % 5 == 4 else r.permutation(100_000)[:400]
            for side in sides:
                side.append(edited(r, base, r.choice([0, 0.01, 0.03, 0.06])) if r.rand() < 0.95 else np.zeros(0, np.uint64))
        every = sides[0] + sides[1]
        row, found = passages.stretches_of(np.concatenate(every), np.concatenate(([0], np.cumsum([len(x) for x in every]))), 46, 80)
        want = [(k, *x) for k, (a, b) in enumerate(zip(*sides, strict=True)) for x in passages.shared_stretches(a, b, 46, 80)]
        assert want and sorted((k, *x) for k, x in zip(row.tolist(), found.tolist(), strict=True)) == sorted(map(tuple, want))


def test_boxes_that_share_too_little_anywhere_are_not_looked_at(monkeypatch):
    """A cloud of texts that share much, but in no window enough; one pair among them does so."""
    looked = []
    for name in ("shared_stretches", "straight_stretches"):
        real = getattr(passages, name)
        monkeypatch.setattr(passages, name, lambda a, *x, real=real, name=name: looked.append(1 if name[1] == "h" else len(set(a.tolist()))) or real(a, *x))
    r = np.random.RandomState(5)
    sets = []
    for i in range(60):
        x = np.arange(120)
        x[r.randint(0, 10, 12) + np.arange(0, 120, 10)] = 1000 + 20 * i + np.arange(12)
        x[::5] = 5000 + 30 * i + np.arange(24)
        sets.append(x.astype(np.uint32))
    sets.append(sets[10].copy())
    none = [np.zeros(120, np.int64) for _ in sets]
    assert passages.joined_boxes(np.arange(61), np.zeros(61, bool), sets, none, 46, 80) == [(10, 60)]
    assert sum(looked) == 1


def test_boxes_of_several_keys_together():
    r = np.random.RandomState(6)
    x = r.permutation(1000)[:60].astype(np.uint32)
    key, rid = np.repeat([0, 1, 2], 3), np.array([1, 2, 2, 3, 4, 5, 6, 6, 6])
    none = np.zeros(60, np.int64)
    got = passages.joined_boxes(rid, np.zeros(9, bool), [x] * 9, [none.copy() for _ in range(9)], 46, 80, key, np.zeros(9, bool))
    assert got == [(0, 1), (0, 2), (3, 4), (3, 5)]
