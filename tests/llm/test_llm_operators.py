"""Brute force, literal and edge cases of the training-data operators."""

import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusweir.llm import (
    catalog, learned_index, line_dedup, lz_fingerprint, mixing, neardup, nearsets, packing, passages, secret_scan, sharding, shingling, toxicity,
)
from corpusweir.llm.tokens import public_path, tokenizer_text, word_tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, root string"
WORDS = [f"w{i}" for i in range(4000)]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def frame(spark, texts, sources=None, ids=None):
    sources = sources or ["a"] * len(texts)
    ids = ids or list(range(len(texts)))
    rows = [(i, t, None, s, None if t is None else len(t), "x", None) for i, t, s in zip(ids, texts, sources, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    texts = [None, "", " \n\t", "one", "same text here", "same text here", prose(1, 30000), "x" * 50000, "é ü\nß"]
    rows = frame(spark, texts, ["a", None, "b", "a", None, None, "b", "c", "c"], [1, 2, 3, 4, 5, 5, None, None, 9])
    return rows.union(rows.filter("doc_id = 4"))


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, ["x"]).limit(0)


OPERATORS = {
    "lines": line_dedup.duplicate_lines,
    "lines out": line_dedup.without_duplicate_lines,
    "secrets": lambda d: secret_scan.digest(secret_scan.secret_spans(d)),
    "shards": sharding.interleaved_shards,
    "packing": lambda d: packing.packed_sequences(d, public_path()),
    "prints": lz_fingerprint.fingerprints,
    "edited": lz_fingerprint.edited_likeness,
    "passages": passages.repeated_passages,
    "near": neardup.near_duplicates,
    "near out": neardup.without_near_duplicates,
    "plan": mixing.mix_plan,
    "mixed": mixing.mixed,
    "toxicity": lambda d: toxicity.toxicity(d, d.selectExpr("doc_id", "cast(null as int) as toxic")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_tables(spark, odd, empty, name):
    assert OPERATORS[name](empty).count() == 0
    out = OPERATORS[name](odd)
    per_row = ("secrets", "shards", "prints", "edited", "near", "plan", "toxicity")
    assert out.count() == odd.count() if name in per_row else out.count() >= 0
    if name in ("lines out", "near out", "mixed"):
        assert out.columns == odd.columns


def test_secret_spans_as_regular_expressions_find_them(spark):
    parts = ["token", "=", '"', " ", ": ", "secret", "abcdefgh", "deadbeef" * 5, "AKIA", "ABCDEFGHIJKLMNOP", "é", "\n", "APIkey", "0" * 33, "passwd"]
    r = random.Random(4)
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 50))) for _ in range(300)]
    kinds = {
        "assign": (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 8),
        "access": ("AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        "hex": ("[0-9a-f]+", lambda m: len(m[0]) >= 32),
    }
    got = {x.doc_id: x for x in secret_scan.digest(secret_scan.secret_spans(frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        spans = []
        for nth, (kind, (pattern, good)) in enumerate(kinds.items()):
            spans += [(m.start(), nth, kind, m.end()) for m in re.finditer(pattern, t) if good(m)]
        text = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans))
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_shards_match_the_mixture(spark):
    out = sharding.interleaved_shards(
        frame(spark, [f"t{i}" for i in range(400)], ["big" if i % 4 else "small" for i in range(400)]), shards=10, carry=["source"]
    ).collect()
    for s in range(10):
        mine = [r for r in out if r.shard == s]
        assert len(mine) == 40 and sorted(r.slot for r in mine) == list(range(40))
        assert sum(r.source == "small" for r in mine) in (9, 10, 11)


def test_packing_is_whole_and_gapless(spark, sf):
    rows = catalog.QUERIES["op6_packed_sequences"](spark, sf).collect()
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    tokens = word_tokens(tokenizer_text(public_path()))
    plain = tokens.tokenizer
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, pieces in by_doc.items():
        ids = np.array(plain.encode(texts[doc], add_special_tokens=False).ids + [0], "<u4")
        assert sum(p.length for p in pieces) == len(ids)
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) and p.start == p.piece * 2048
    assert set(by_doc) == set(texts)
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048


def test_packing_plan_uses_exact_complements():
    assert sum(n for _, n in packing.packing_plan({6: 1, 4: 1, 7: 2, 1: 2, 2: 2, 5: 1, 3: 1}, 10)) == 4
    for seed in range(40):
        r = random.Random(seed)
        counts = {r.randint(1, 50): r.randint(1, 60) for _ in range(20)}
        back = {}
        for lengths, n in packing.packing_plan(counts, 50):
            assert sum(lengths) <= 50
            for x in lengths:
                back[x] = back.get(x, 0) + n
        assert back == counts


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("small", [1, 32])
def test_near_duplicates_as_brute_force_finds_them(spark, monkeypatch, small):
    monkeypatch.setattr("corpusweir.llm.nearsets.SMALL", small)
    monkeypatch.setattr("corpusweir.llm.nearsets.BLOCK", 16)
    r, texts = random.Random(2), []
    for base in range(6):
        words = prose(100 + base, 120).split()
        for _ in range(30):
            own = [w if r.random() > 0.03 * (base + 1) / 3 else "edit" + str(r.randint(0, 9999)) for w in words]
            texts.append(" ".join(own))
    texts += ["", None, "a", "A", "a b"]
    sets = [shingles(t, 2) for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = roots(len(texts), links)
    got = {x.doc_id: x for x in neardup.near_duplicates(frame(spark, texts), neardup.WORD_PAIRS).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]


def test_lines_as_brute_force_finds_them(spark):
    r, lines = random.Random(3), []
    for base in range(40):
        text = prose(500 + base, 25)
        for _ in range(4):
            at = r.randrange(len(text))
            lines.append(text[:at] + "zq" + text[at + 1 :] if r.random() < 0.8 else text)
    r.shuffle(lines)
    grams = [{x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in lines]
    links = [(i, j) for i, j in itertools.combinations(range(len(lines)), 2) if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])]
    docs = frame(spark, ["\n".join(lines[i : i + 10]) for i in range(0, len(lines), 10)])
    got = {(x.doc_id, x.line_no): (x.first_id, x.first_line) for x in line_dedup.duplicate_lines(docs).collect()}
    want = roots(len(lines), links)
    same = sum(got[divmod(i, 10)] == divmod(want[i], 10) for i in range(len(lines)))
    assert same >= 0.98 * len(lines)
    left = line_dedup.without_duplicate_lines(docs)
    assert sum(len(x.text.split("\n")) for x in left.collect()) == len(set(got.values()))


def test_lines_at_the_threshold_share_a_band():
    r, missed, pairs = np.random.RandomState(12), 0, 3000
    sets = []
    for _ in range(pairs):
        x = r.randint(0, 1 << 63, 100, np.int64).astype(np.uint64) * np.uint64(2)
        sets += [np.sort(x[:90]), np.sort(np.concatenate((x[:80], x[90:])))]
    keys = line_dedup.LINES.keys(line_dedup.LINES.minima(sets))
    missed = int((~(keys[0::2] == keys[1::2]).any(axis=1)).sum())
    assert missed <= 0.004 * pairs, missed


def test_repeated_passages(spark):
    shared, short = prose(9000, 60), prose(9001, 30)
    texts = [f"{prose(i, 300)} {shared if i % 3 == 0 else ''} {short} {prose(i + 50, 1200 if i == 3 else 80)}" for i in range(12)]
    edited = shared.split()
    edited[20] = "changed"
    texts.append(prose(77, 100) + " " + " ".join(edited * 1) + " " + prose(78, 100))
    got = passages.repeated_passages(frame(spark, texts)).collect()
    found = {x.doc_id for x in got}
    assert found == {0, 3, 6, 9, 12}
    for x in got:
        if x.doc_id in (0, 3, 6, 9):
            words = texts[x.doc_id].split()[x.start_word : x.end_word]
            assert " ".join(words) in shared + " " + short and len(words) >= 50


@pytest.mark.parametrize("block", [8, 1024])
def test_passages_behind_a_common_phrase(spark, monkeypatch, block):
    """Every key of a passage may be that of a phrase of under 50 words that all rows hold."""
    monkeypatch.setattr("corpusweir.llm.passages.BLOCK", block)
    phrase, texts = prose(8000, 44), []
    for i in range(60):
        own = prose(8100 + i, 8)
        texts += [f"{prose(8200 + 2 * i + k, 120)} {phrase} {own} {prose(8400 + 2 * i + k, 120)}" for k in range(2)]
    random.Random(5).shuffle(texts)
    grams = [shingles(t, 5) for t in texts]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if len(grams[i] & grams[j]) >= 46]
    assert len(pairs) == 60
    got = {x.doc_id: x.first_id for x in passages.repeated_passages(frame(spark, texts)).collect()}
    missed = [p for p in pairs if p[0] not in got or p[1] not in got]
    assert not missed, len(missed)


def test_passage_beside_one_that_all_rows_share(spark):
    """A passage found elsewhere in a segment says nothing of the box of another one."""
    everywhere, phrase, texts = prose(8800, 60), prose(8801, 44), []
    for i in range(30):
        own = prose(8900 + i, 8)
        texts += [f"{prose(9100 + 2 * i + k, 60)} {everywhere} {prose(9300 + 2 * i + k, 60)} {phrase} {own} {prose(9500 + 2 * i + k, 60)}" for k in range(2)]
    random.Random(6).shuffle(texts)
    found = {}
    for x in passages.repeated_passages(frame(spark, texts)).collect():
        found.setdefault(x.doc_id, []).append(x.end_word - x.start_word)
    assert all(len(found[i]) == 2 for i in range(len(texts)))


def test_recall_of_passages_at_the_threshold(spark):
    texts = []
    for i in range(200):
        own = prose(7000 + i, 50).split()
        texts.append(f"{prose(3000 + i, 80)} {' '.join(own)} {prose(4000 + i, 80)}")
        own[22 + i % 6] = "changed"
        texts.append(f"{prose(5000 + i, 95)} {' '.join(own)} {prose(6000 + i, 65)}")
    found = {x.doc_id for x in passages.repeated_passages(frame(spark, texts)).collect()}
    assert sum({2 * i, 2 * i + 1} <= found for i in range(200)) >= 198


def test_runs_of_repeated_phrases_at_any_start():
    def shingled(text):
        hashes, _, _, offsets = shingling.words([text.encode()])
        return shingling.word_shingles(hashes, offsets, 5, whole=False)[0]

    for before, phrase in itertools.product(range(0, 46, 3), ("ha", "one two three", "a b c d e f")):
        run = " ".join((phrase.split() * 50)[:50])
        a, b = (f"{prose(seed, 30 + before * k)} {run} {prose(seed + 1, 70)}" for seed, k in ((40, 1), (50, 2)))
        found = passages.shared_stretches(shingled(a), shingled(b), 46, 80)
        assert any(s <= 30 + before and 30 + before + 46 <= e and f <= 30 + 2 * before and 30 + 2 * before + 46 <= g for s, e, f, g in found)
    # A passage of which a third is one word over and over, the rest its own.
    mixed = f"{prose(60, 32)} {' '.join(['ha'] * 22)}"
    a, b = f"{prose(61, 40)} {mixed} {prose(62, 40)}", f"{prose(63, 71)} {mixed} {prose(64, 40)}"
    assert passages.shared_stretches(shingled(a), shingled(b), 46, 80)
    assert not passages.shared_stretches(shingled(a), shingled(f"{prose(65, 50)} {' '.join(['ha'] * 22)} {prose(66, 50)}"), 46, 80)


def test_equal_texts_and_edits_of_fingerprints(spark):
    texts = [prose(1, 300), prose(2, 300), prose(2, 300), "", "a"]
    got = {x.doc_id: x for x in lz_fingerprint.edited_likeness(frame(spark, texts)).collect()}
    assert got[1].fingerprint == got[2].fingerprint and got[2].near_next == 1.0
    for i, x in got.items():
        after = texts[i - 1] if i else texts[-1]
        n = len(texts[i])
        edited = texts[i][: n - n // 2] + after[: n // 2]
        assert x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and x.n_chars == n
        codes = lz_fingerprint.code_array(edited)
        whole = lz_fingerprint.Parse().feed(codes.tolist()).fingerprint(codes, lz_fingerprint.MinHash(lz_fingerprint.MINIMA))
        assert x.edited_fingerprint == lz_fingerprint.as_text(whole)
    assert got[1].near_edited > got[1].near_next


def test_neighbours_recall_and_exact_scores(spark, sf):
    got = catalog.QUERIES["op3_learned_neighbours"](spark, sf).collect()
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], float)
    ids = np.array([r.vec_id for r in rows])
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = set(ids[np.lexsort((ids, d))[:10]].tolist())
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        hits, total = hits + len(best & {v for _, v, _ in mine}), total + 10
        assert all(abs(s - d[ids == v][0]) < 1e-12 for _, v, s in mine)
    assert hits >= 0.9 * total


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [1.0]), (None, [1.0, 1.0]), (6, [1.0, 0.0]), (7, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id) for r in learned_index.nearest_neighbours(df).orderBy("rank").collect()] == [(1, 6), (2, 7)]
    assert learned_index.nearest_neighbours(df.limit(0)).count() == 0


def test_toxicity_on_held_out_misspellings():
    r = random.Random(6)
    bad = ["worthless", "pathetic", "disgusting", "scumbag"]
    texts = [f"{prose(i, 60)} {' '.join(r.choice(bad) for _ in range(4))}" if i % 2 else prose(i, 64) for i in range(200)]
    scorer = toxicity.Scorer(toxicity.fit(texts, [i % 2 for i in range(200)]))
    scores = scorer.score([f"{prose(900, 60)} worthles patheticc disgustin", prose(901, 63), "", None])
    assert scores[0] > 5 * scores[1] and scores[1] < 0.5 and scores[2] == scores[3]


def test_mixed_rows_are_the_planned_words(spark):
    docs = frame(spark, [prose(i, 20 + i) for i in range(60)], ["a" if i < 40 else "b" if i < 58 else None for i in range(60)])
    plan = mixing.mix_plan(docs, carry=("source",)).collect()
    taken, target = {}, {}
    for p in plan:
        taken[p.source] = taken.get(p.source, 0) + p.taken
        target[p.source] = p.target
        assert p.taken <= 3 * p.size
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    out = mixing.mixed(docs).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()
    assert {r.source: r.n for r in out} == taken


def test_pipeline_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
    assert docs.count() > 0


def test_exactly_one_first_copy_of_a_passage(spark):
    """Copies meet through others, in rows whose ids are in no order, also twice in one row."""
    shared = [prose(9700 + k, 300) for k in range(2)]
    ids = [70, 30, 90, 20, 80, 40, 60, 50, 10]
    texts = [f"{prose(9710 + i, 40 + 31 * i)} {shared[i % 2]} {prose(9750 + i, 60)}" for i in range(8)]
    texts.append(f"{prose(9790, 50)} {shared[0]} {prose(9791, 50)} {shared[0]} {prose(9792, 20)} {shared[1][:1200]}")
    got = passages.repeated_passages(frame(spark, texts, ids=ids)).collect()
    by_passage = [[x for x in got if any(w in texts[ids.index(x.doc_id)].split()[x.start_word : x.end_word] for w in [s.split()[100]])] for s in shared]
    for rows, members in zip(by_passage, ([70, 90, 80, 60, 10, 10], [30, 20, 40, 50, 10]), strict=True):
        assert sorted(x.doc_id for x in rows) == sorted(members)
        assert {x.first_id for x in rows} == {10} and sum(x.first_copy for x in rows) == 1


def test_a_repeated_query_row_asks_once(spark):
    r = np.random.RandomState(21)
    x = r.normal(size=(40, 8))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = learned_index.nearest_neighbours(spark.createDataFrame([*rows, rows[0]], "vec_id long, embedding array<double>"))
    true = sorted(range(1, 40), key=lambda j: np.linalg.norm(x[j] - x[0]))[:10]
    assert [r["vec_id"] for r in got.orderBy("rank").collect()] == true


def test_boxes_of_classes_that_only_hang_together_through_each_other():
    x = np.arange(100, 146, dtype=np.uint32)
    alone = np.zeros(2, bool)
    def found(*classes):
        return passages.joined_boxes(np.arange(2), alone, [x, x.copy()], [np.full(46, c, np.int64) for c in classes], 46, 80)

    assert found(1, 2) == [(0, 1)] and found(0, 2) == [(0, 1)] and found(1, 1) == []
    # A first and a second half that stand in two classes on both sides: the whole links them.
    halves = np.repeat([1, 2], 23)
    assert passages.joined_boxes(np.arange(2), alone, [x, x.copy()], [halves, halves.copy()], 46, 80) == [(0, 1)]


@pytest.mark.parametrize("across", [False, True])
def test_boxes_of_a_key_hang_together_as_all_pairs_say(across):
    def roots(n, links):
        root = list(range(n))
        for _ in range(n):
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        return root

    for seed in range(12):
        r = np.random.RandomState(seed)
        sets, new = [], 10_000
        for _ in range(3):
            x = np.concatenate((np.arange(20), r.randint(100, 5000, 30))).astype(np.uint32)
            for _ in range(12):
                x = x.copy()
                x[r.choice(30, 2, False) + 20] = new, new + 1
                new += 2
                sets.append(x)
        order = r.permutation(len(sets))
        sets = [sets[k] for k in order]
        rid, second = r.randint(0, 30, len(sets)), r.rand(len(sets)) < 0.5 if across else np.zeros(len(sets), bool)
        pairs = [
            (i, j) for i, j in itertools.combinations(range(len(sets)), 2)
            if rid[i] != rid[j] and (not across or second[i] != second[j]) and passages.shared_stretches(sets[i], sets[j], 46, 80)
        ]
        got = passages.joined_boxes(rid, second, sets, [np.zeros(50, np.int64) for _ in sets], 46, 80)
        assert set(got) <= set(pairs) and len(got) < len(pairs)
        assert roots(len(sets), got) == roots(len(sets), pairs)


def test_texts_tokenised_together_as_one_by_one():
    texts = [prose(i, 50) + " Word! word? x" + "y" * 80 + f" n{i}." for i in range(20)] + ["", "é\u0301 a\x1cb <|endoftext|>", "ſ ﬁ ß...", "-- ,"]
    tokens = type(word_tokens(tokenizer_text(public_path())))(tokenizer_text(public_path()))
    want = [np.array(tokens.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    calls, fresh = [], tokens.fresh
    tokens.fresh = lambda parts: calls.append(len(parts)) or fresh(parts)
    assert tokens.encode_all(texts) == want
    assert tokens.encode_all(texts) == want
    # New pieces of all texts are learnt at once; what is not kept is learnt again, and one text is always read whole.
    assert len(calls) == 4 and max(calls) == calls[0]


def test_the_toxicity_model_is_fitted_in_a_task(spark, monkeypatch):
    texts = [f"{prose(i, 20)} {'awful scum' if i % 2 else ''}" for i in range(60)]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    names = {"id_col": "doc_id", "text_col": "text", "label_col": "toxic"}
    kept = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    want = toxicity.fit([texts[i] for i in kept], [i % 2 for i in kept])
    got = toxicity.fitted(docs, labels, 100, **names)
    assert got.bias == want.bias and np.array_equal(got.weight, want.weight)
    here = os.getpid()
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: toxicity.Model(np.zeros(1), float(os.getpid() == here)))
    assert toxicity.fitted(docs, labels, 100, **names).bias == 0


@pytest.mark.parametrize(("hub", "strays"), [(3000, 20), (40, 100), (10, 5)])
def test_members_of_a_bucket_meet_all_other_components(spark, monkeypatch, hub, strays):
    monkeypatch.setattr("corpusweir.llm.nearsets.BLOCK", 64)
    rows = [(7, i, 1 if i < hub else i) for i in range(hub + strays)]
    placed = nearsets.blocked(spark.createDataFrame(rows, "key long, id long, root long")).collect()
    assert sorted((x.key, x.id, x.root) for x in placed) == rows
    tasks = {}
    for x in placed:
        for other in range(x._others):
            tasks.setdefault((min(x.block, other), max(x.block, other)), []).append(x)
    met = set()
    for (first, second), members in tasks.items():
        for a in (x for x in members if x.block == first):
            met |= {tuple(sorted((a.id, b.id))) for b in members if b.block == second and b.root != a.root}
    assert met == {(i, j) for i in range(hub + strays) for j in range(max(i + 1, hub), hub + strays)}
    # The largest component is not dealt to itself: its members travel once if there are few others.
    assert sum(x._others for x in placed) <= hub * -(-strays // 64) + strays * (-(-hub // 64) + -(-strays // 64))
