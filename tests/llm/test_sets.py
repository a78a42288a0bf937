"""Sets, comparisons and phrases beside plain Python."""

import random

import numpy as np

from corpusweir.llm.lz_fingerprint import MINIMA, Parse
from corpusweir.llm.nearsets import TOGETHER, Similarity, together
from corpusweir.llm.shingling import MinHash, char_shingles

LINES = Similarity("chars", k=5, hashes=64, rows=4, bands=12)


def _texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdé\U0001f600 ") for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 40, 300]))) for _ in range(n)]


def test_sets_of_a_batch_are_those_of_each_text():
    texts = _texts(200) + ["", "a", "aaaaaaaaaaaa"]
    for text, found in zip(texts, LINES.sets(texts), strict=True):
        alone = char_shingles(np.frombuffer(text.encode("utf-32-le"), np.uint32), 5)
        assert found.tolist() == alone.tolist()
    assert LINES.sets([]) == []


def test_ranges_hold_every_text_once():
    texts = ["a" * n for n in (5, 9, 1, 30, 2, 2)]
    ranges = list(together(texts, limit=10))
    assert [i for a, b in ranges for i in range(a, b)] == list(range(6))
    assert all(b - a == 1 or sum(map(len, texts[a:b])) <= 10 for a, b in ranges)
    assert list(together([])) == [] and TOGETHER > 0


def test_one_against_many_as_one_against_one():
    base = _texts(1, seed=8)[0] + "the quick brown fox jumps over the lazy dog " * 3
    rng = random.Random(5)
    others = [base, "", "x", *("".join(c if rng.random() > p else "z" for c in base) for p in (0.005, 0.02, 0.05, 0.3) for _ in range(20))]
    a, *sets = LINES.sets([base, *others])
    together_ = LINES.similar_among(a, sets).tolist()
    assert together_ == [LINES.similar(a, s) for s in sets]
    assert any(together_) and not all(together_)


def _phrases(text):
    """Phrases of a growing dictionary, with strings and a set."""
    known, phrase = set(), ""
    for c in text:
        phrase += c
        if phrase not in known:
            known.add(phrase)
            phrase = ""
    return known | ({phrase} if phrase else set())


def test_phrases_share_what_an_exact_parse_says():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    text = " ".join(rng.choice(words) for _ in range(900))
    minhash = MinHash(MINIMA)
    for share in (1.0, 0.9, 0.5, 0.0):
        other = text[: int(len(text) * share)] + " ".join(rng.choice(words)[::-1] for _ in range(int(900 * (1 - share))))
        prints = []
        for t in (text, other):
            codes = np.frombuffer(t.encode("utf-32-le"), np.uint32)
            prints.append(Parse().feed(codes.tolist()).fingerprint(codes, minhash))
        a, b = _phrases(text), _phrases(other)
        exact = len(a & b) / len(a | b)
        # Four standard deviations of an estimate from the minima.
        assert abs(float((prints[0] == prints[1]).mean()) - exact) <= 4 * (exact * (1 - exact) / MINIMA) ** 0.5 + 0.01
