"""Vector links, centroid clusters and spelling variants beside brute force, and their odd cases."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusweir.llm import cover_tree, hadamard_clusters, spelling, vector_links

VECTORS = "vec_id long, embedding array<double>, label int, _key string, cluster string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", None) for i, v, label in rows], VECTORS)


@pytest.fixture(scope="module")
def odd_vectors(spark):
    one, other = [1.0] + [0.5] * 63, [0.0] * 63 + [2.0]
    return vectors(spark, [
        (1, None, 1), (2, [], 1), (3, [0.0] * 64, 1), (4, one, 1), (5, one, 1), (5, one, 1), (None, one, 1), (6, [None] + one[1:], 1),
        (7, [float("nan")] + one[1:], 1), (8, [float("inf")] + one[1:], 1), (9, one, None), (10, one, 2), (11, one[:63], 1),
        (12, other, 2), (None, other, 3), (13, [-0.0] + other[1:], 2), (14, [v * 1e-3 for v in one], 1), (None, None, None),
    ])


def cloudy(seed, n, width=12):
    """Scattered vectors, clouds of near ones of several widths and exact copies."""
    r = np.random.RandomState(seed)
    centres = r.normal(size=(6, width))
    out = []
    for i in range(n):
        kind = r.randint(8)
        v = r.normal(size=width) if kind == 0 else centres[kind % 6] + r.normal(size=width) * (0.02, 0.1, 0.3, 0.45)[kind % 4]
        out.append(v * r.uniform(0.1, 9))
    for i in r.randint(0, n, n // 4):
        out.append(out[i])
    return out


def links_of(rows, cosine=0.93):
    n, root = Counter(), {i: i for i, _, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, u, x) in enumerate(rows):
        for j, v, y in rows[a + 1 :]:
            if x == y and np.dot(u, v) / (np.linalg.norm(u) * np.linalg.norm(v)) >= cosine:
                n[i] += 1
                n[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: (n[i], find(i), find(i) == i) for i, _, _ in rows}


@pytest.mark.parametrize("block,pivots", [(8192, 256), (32, 8), (16, 2)])
def test_vector_links_as_all_pairs_find_them(spark, block, pivots):
    rows = [(1000 - 3 * k if k % 2 else 1001 + k, [float(c) for c in v], 0 if k % 3 else k % 2 + 1) for k, v in enumerate(cloudy(1, 500))]
    out = vector_links.vector_links(vectors(spark, rows), block=block, pivots=pivots)
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out.collect()} == links_of(rows)


def test_a_cloud_beyond_a_block_is_counted_whole(spark):
    r = np.random.RandomState(2)
    rows = [(i, (np.eye(8)[0] + r.normal(size=8) * 0.02).tolist(), 1) for i in range(300)]
    rows += [(1000 + i, v.tolist(), 1) for i, v in enumerate(r.normal(size=(100, 8)))]
    out = vector_links.vector_links(vectors(spark, rows), block=20, pivots=6)
    assert {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in out.collect()} == links_of(rows)


def test_traversal_leaves_far_nodes_alone():
    r = np.random.RandomState(3)
    centres = r.normal(size=(20, 16))
    raw = np.concatenate([centres[i % 20][None] + r.normal(size=(1, 16)) * 0.15 for i in range(4000)])
    found = cover_tree.CloseRows(raw, np.ones(4000, np.int64), 4000, 0.93)
    unit = cover_tree.unit_rows(raw)
    assert (found.total == (unit @ unit.T >= 0.93).sum(axis=1)).all()
    assert found.compared < 4000 * 4000 / 8


def test_tree_radii_halve_and_cover():
    x = cover_tree.unit_rows(np.array(cloudy(4, 1500)))
    tree = cover_tree.CoverTree(x)
    for node in tree.nodes:
        assert (cover_tree.apart(x[node.members], x[[node.centre]]) <= node.radius + 1e-6).all()
        if node.children:
            assert sorted(np.concatenate([tree.nodes[c].members for c in node.children])) == sorted(node.members)


def test_odd_vectors_have_defined_links(spark, odd_vectors):
    out = vector_links.vector_links(odd_vectors)
    assert out.count() == odd_vectors.count()
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in out.collect())
    assert got == sorted([
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 4, 4, True), (5, 4, 4, False), (5, 4, 4, False), (0, 4, 4, False),
        (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (10, 0, 10, True), (11, 0, 11, True), (12, 1, 12, True),
        (0, 0, 0, True), (13, 1, 12, False), (14, 4, 4, False), (0, 0, 0, True),
    ])
    assert vector_links.vector_links(odd_vectors.limit(0)).count() == 0
    assert vector_links.vector_links(odd_vectors.filter("embedding is null")).count() == 2


def clusters_of(rows, k, rounds, seed=2):
    kept = [(i, np.floor(np.array(v) * 256).astype(np.int64)) for i, v in rows]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[0], r[1].tolist()))
    centres = np.array([v for _, v in first[:k]])
    x = np.array([v for _, v in kept])
    for step in range(rounds + 1):
        gap = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
        own = gap.argmin(axis=1)
        if step < rounds:
            for c in range(len(centres)):
                if (own == c).any():
                    centres[c] = x[own == c].sum(axis=0) // (own == c).sum()
    d = gap.min(axis=1)
    sha = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centres]
    return sorted((i, int(c), int(g), int(d[own == c].sum()), int(d.sum()), sha[c]) for (i, _), c, g in zip(kept, own, d, strict=True))


@pytest.mark.parametrize("n,k", [(600, 7), (600, 40), (12, 40)])
def test_clusters_as_all_distances_find_them(spark, n, k):
    r = np.random.RandomState(5)
    # Few different values, so that distances tie.
    rows = [(int(i), (r.randint(-2, 3, 64) / 8).tolist()) for i in r.permutation(n)]
    rows += rows[: n // 6]
    out = hadamard_clusters.progressive_clusters(vectors(spark, [(i, v, 1) for i, v in rows]), k=k)
    assert sorted(tuple(x) for x in out.collect()) == clusters_of(rows, k, 5)


def test_progressive_search_forms_fewer_differences():
    r = np.random.RandomState(6)
    centres = r.randint(-200, 200, (40, 64))
    x = centres[r.randint(0, 40, 3000)] + r.randint(-30, 30, (3000, 64))
    cluster, distance, formed = hadamard_clusters.nearest(hadamard_clusters.coefficients(x), hadamard_clusters.coefficients(centres))
    gap = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (cluster == gap.argmin(axis=1)).all() and (distance == gap.min(axis=1)).all()
    assert formed < 3000 * 40 * 64 / 3


def test_odd_vectors_are_kept_or_left_out(spark, odd_vectors):
    out = hadamard_clusters.progressive_clusters(odd_vectors)
    # All rows but null, empty, shorter ones and those with components that are null or not finite.
    assert sorted(r["vec_id"] or 0 for r in out.collect()) == [0, 0, 3, 4, 5, 5, 9, 10, 12, 13, 14]
    assert hadamard_clusters.progressive_clusters(odd_vectors.limit(0)).count() == 0
    with pytest.raises(Exception, match="not within"):
        hadamard_clusters.progressive_clusters(vectors(spark, [(1, [1e9] * 64, 1)]))


def edits(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def vocabulary(seed, n):
    r = random.Random(seed)
    out = set()
    while len(out) < n:
        word = "".join(r.choice("abcéßñ") for _ in range(r.randint(7, 11)))
        out.add(word)
        for _ in range(3):
            at = r.randrange(len(word))
            out.add(r.choice([word[:at] + word[at + 1 :], word[:at] + r.choice("abcé") + word[at:], word[:at] + r.choice("abc") + word[at + 1 :]]))
    return sorted(w for w in out if len(w) >= 7)


@pytest.mark.parametrize("cell,block,asked", [(4096, 16384, 65536), (40, 25, 60)])
def test_near_words_as_all_pairs_find_them(spark, cell, block, asked):
    words = vocabulary(1, 900) + ["x" * 200, "x" * 201, "y" * 200 + "x", "x" * 199 + "y"]
    frame = spark.createDataFrame([(w, len(w)) for w in words], "word string, n bigint")
    got = [(r["word"], r["near"], r["near_n"]) for r in spelling.near_words(frame, cell, block, asked).collect()]
    wanted = [(a, b, len(b)) for a in words for b in words if a != b and edits(a, b)]
    assert sorted(got) == sorted(wanted)


def variants_of(docs):
    n = Counter()
    for i, text in docs:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                at = h % len(run)
                n[run[:at] + run[at + 1 :] if h % 31 == 0 else run] += 1
            run = ""
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if v != w and edits(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def test_spelling_variants_as_brute_force_finds_them(spark):
    r = random.Random(7)
    base = vocabulary(8, 60)
    weights = [3 ** r.randint(0, 6) for _ in base]
    docs = [(i, " ".join(w.upper() if r.random() < 0.1 else w for w in r.choices(base, weights, k=400))) for i in range(40)]
    docs += [(None, "straßen×÷ÿ straßen×÷ÿ kurz"), (None, None), (50, ""), (51, "z" * 30000 + " " + "z" * 30000), (3, docs[3][1]), (52, "éa" * 5 + "Āabcdefg")]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    got = {tuple(x) for x in spelling.spelling_variants(frame).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == variants_of(docs)
    assert any(root != form for _, form, root, *_ in got if form)
    assert spelling.spelling_variants(frame.limit(0)).count() == 0
