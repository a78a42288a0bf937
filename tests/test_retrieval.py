"""Retrieval operators against small brute-force versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusweir.config import FusionSettings, PathSettings, RetrievalConfig, preset
from corpusweir.operators import bm25, fusion, memo, normalise, parents, rerank
from corpusweir.operators.vector import clipped_cosine, most_similar, vector_topk
from corpusweir.plans.progressive import STAGES, with_stage

random.seed(5)
WORDS = [f"w{i}" for i in range(40)]
DOCS = [(i, " ".join(random.choices(WORDS, weights=range(40, 0, -1), k=random.randint(0, 30)))) for i in range(120)]
QUERIES = [(q, " ".join(random.choices(WORDS, k=6))) for q in range(9)]


def okapi(docs, query):
    toks = {i: t.split() for i, t in docs}
    n, avgdl = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(w for t in toks.values() for w in set(t))
    idf = {w: math.log((n - c + 0.5) / (c + 0.5)) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    out = {}
    for i, t in toks.items():
        tf = Counter(t)
        out[i] = sum(
            (idf[w] if idf[w] >= 0 else floor) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avgdl))
            for w in query.split() if tf[w])
    return out


def frames(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    return bm25.field_rows(docs, {"content": "text"}), spark.createDataFrame(QUERIES, "query_id long, text string")


def expected(k):
    out = {}
    for q, text in QUERIES:
        scores = {i: round(s, 9) for i, s in okapi(DOCS, text).items() if s > 0}
        out[q] = sorted(scores, key=lambda i: (-scores[i], i))[:k]
    return out


def ranked(df):
    rows = sorted(df.collect(), key=lambda r: (r.query_id, r.rank))
    out = {q: [] for q, _ in QUERIES}
    for r in rows:
        out[r.query_id].append(r.doc_id)
    return out


def test_bm25_matches_brute_force(spark):
    rows, queries = frames(spark)
    assert ranked(bm25.search_fields(rows, queries, 7)) == expected(7)


def test_bm25_join_path_gives_the_same(spark, monkeypatch):
    rows, queries = frames(spark)
    monkeypatch.setattr(bm25, "few_terms", lambda *_: False)
    assert ranked(bm25.search_fields(rows, queries, 7)) == expected(7)


def test_bm25_small_blocks_give_the_same(spark, monkeypatch):
    rows, queries = frames(spark)
    monkeypatch.setattr(bm25, "PAIRS_IN_MEMORY", 20)
    assert ranked(bm25.search_fields(rows, queries, 7)) == expected(7)


def test_bm25_saved_index(spark, tmp_path):
    rows, queries = frames(spark)
    bm25.write_index(rows, str(tmp_path / "index"))
    index = bm25.read_index(spark, str(tmp_path / "index"))
    assert ranked(bm25.search_index(index, queries, 7)) == expected(7)
    hits = bm25.hits_from_index(index, bm25.query_terms(queries), prune_terms=0)
    assert hits.count() == bm25.hits_from_index(index, bm25.query_terms(queries)).count()


def test_bm25_keyword_case(spark):
    docs = spark.createDataFrame([
        (1, "高血压 慢性疾病 医学"), (2, "糖尿病 代谢性疾病 医学"), (3, "心脏病 心血管 疾病")], "doc_id long, text string")
    queries = spark.createDataFrame([(0, "高血压")], "query_id long, text string")
    found = bm25.search_fields(bm25.field_rows(docs, {"keywords": "text"}), queries, 3).collect()
    assert found[0].doc_id == 1 and found[0].score > 0


def test_bm25_empty_query_set(spark):
    rows, _ = frames(spark)
    none = spark.createDataFrame([], "query_id long, text string")
    assert bm25.search_fields(rows, none, 3).count() == 0


def vectors(n, seed):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in np.round(rng.normal(size=8), 2)]) for i in range(n)]


def nearest(vecs, qs, k, skip_self=False):
    out = {}
    for q, qv in qs:
        s = {}
        for i, v in vecs:
            if skip_self and i == q:
                continue
            a, b = np.array(v, np.float32).astype(float), np.array(qv, np.float32).astype(float)
            s[i] = round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9)
        out[q] = sorted(s, key=lambda i: (-s[i], i))[:k]
    return out


@pytest.mark.parametrize("block", [4096, 3])
def test_vector_topk(spark, block):
    vecs, qs = vectors(80, 1), vectors(8, 2)
    v = spark.createDataFrame(vecs, "doc_id long, embedding array<float>").repartition(3)
    q = spark.createDataFrame(qs, "query_id long, embedding array<float>")
    found = ranked(vector_topk(v, q, 5, query_block=block)) 
    assert {k: x for k, x in found.items() if x} == nearest(vecs, qs, 5)


def test_vector_self_exclusion_and_argmax(spark):
    vecs = vectors(30, 3)
    v = spark.createDataFrame(vecs, "doc_id long, embedding array<float>")
    q = v.withColumnRenamed("doc_id", "query_id")
    found = vector_topk(v, q, 2, exclude_self=True).collect()
    best = nearest(vecs, vecs, 2, skip_self=True)
    assert all(r.doc_id == best[r.query_id][r["rank"] - 1] for r in found) and len(found) == 60
    assert all(r.doc_id == r.query_id for r in most_similar(v, q).collect())
    assert most_similar(v.limit(0), q).agg(F.max("doc_id")).first()[0] == -1


def test_cosine_of_equal_vectors(spark):
    row = spark.range(1).select(
        clipped_cosine(F.array(*map(F.lit, [1.0, 0.0, 0.0])), F.array(*map(F.lit, [1.0, 0.0, 0.0]))).alias("same"),
        clipped_cosine(F.array(*map(F.lit, [1.0, 0.0])), F.array(*map(F.lit, [-1.0, 0.0]))).alias("opposite"),
        clipped_cosine(F.array(*map(F.lit, [0.0, 0.0])), F.array(*map(F.lit, [1.0, 0.0]))).alias("zero")).first()
    assert tuple(row) == (1.0, 0.0, 0.0)


def lists(spark):
    return spark.createDataFrame(
        [(1, "vector", 1, "a", 0.9), (1, "vector", 2, "b", 0.5), (1, "keywords", 1, "b", 3.0), (1, "keywords", 2, "c", 3.0)],
        "query_id long, path string, rank long, doc_id string, score double")


def test_fusion_values(spark):
    got = {r.doc_id: r for r in fusion.weighted_rrf(lists(spark), {"vector": 0.6, "keywords": 0.4}).collect()}
    assert got["b"].fusion_score == pytest.approx(0.6 / 62 + 0.4 / 61)
    assert got["b"].path_contributions["keywords"]["score"] == 1.0
    assert [r.doc_id for r in fusion.weighted_sum(lists(spark), {"vector": 0.6, "keywords": 0.4}).orderBy("rank").collect()] == ["a", "b", "c"]
    assert [r.doc_id for r in fusion.max_score(lists(spark)).orderBy("rank").collect()] == ["b", "c", "a"]
    assert fusion.fuse("simple_rrf", lists(spark)).first().doc_id == "b"
    with pytest.raises(ValueError):
        fusion.fuse("none", lists(spark))


def test_zero_weight_drops_a_path(spark):
    got = fusion.weighted_rrf(lists(spark), {"vector": 1.0, "keywords": 0.0}).collect()
    assert {r.doc_id for r in got} == {"a", "b"}


def test_first_score_skips_zero(spark):
    df = spark.createDataFrame([(0.0, 0.4, 0.7, 0.1), (0.0, 0.0, 0.0, 0.2)],
                               "bm25_score double, similarity_score double, score double, rerank_score double")
    assert [r[0] for r in df.select(fusion.first_score(df)).collect()] == [0.4, 0.2]


def test_normalisers_edge_cases(spark):
    df = spark.createDataFrame([("one", 1, 5.0), ("same", 1, 2.0), ("same", 2, 2.0)], "q string, d long, score double")
    low = {(r.q, r.d): r.norm for r in normalise.min_max(df, ["q"]).collect()}
    assert low == {("one", 1): 5.0, ("same", 1): 1.0, ("same", 2): 1.0}
    z = {(r.q, r.d): r.norm for r in normalise.z_score(df, ["q"]).collect()}
    assert z == {("one", 1): 5.0, ("same", 1): 0.0, ("same", 2): 0.0}
    k = {(r.q, r.d): r.norm for r in normalise.by_rank(df, ["q"], "d").collect()}
    assert k == {("one", 1): 1.0, ("same", 1): 1.0, ("same", 2): 0.5}


def test_dedup_keeps_rows_without_a_parent(spark):
    df = spark.createDataFrame(
        [(1, "v", 1, "a", "p"), (1, "v", 2, "b", "p"), (1, "v", 3, "c", None), (1, "v", 4, "d", None)],
        "query_id long, path string, rank long, doc_id string, parent_id string")
    got = sorted((r["rank"], r.doc_id) for r in parents.dedup_parents(df).collect())
    assert got == [(1, "a"), (2, "c"), (3, "d")]


def test_rerank_strategies(spark):
    docs = spark.createDataFrame(
        [(1, "doc1", "x", 0.1, 0.9), (1, "doc2", "y", 0.2, 0.1), (1, "doc3", " ", 0.3, 0.5), (1, "doc4", "z", None, None)],
        "query_id long, doc_id string, content string, fusion_score double, similarity_score double")
    scores = spark.createDataFrame([(1, "doc2", 0.9), (1, "doc1", 0.5), (1, "doc3", 0.3)],
                                   "query_id long, doc_id string, rerank_score double")
    order = lambda df: [r.doc_id for r in df.orderBy("rank").collect()]
    assert order(rerank.rerank("model", docs, 3, scores)) == ["doc2", "doc1"]
    assert order(rerank.rerank("similarity", docs, 4)) == ["doc1", "doc3", "doc2", "doc4"]
    fused = {r.doc_id: r.fused_rerank_score for r in rerank.rerank("model", docs, 4).collect()}
    assert fused["doc1"] == pytest.approx((0.04 + 0.18) / 0.6) and fused["doc4"] == 0.0
    by_length = rerank.by_model(docs.withColumn("query", F.lit("q")), lambda q, c: c.str.len().astype(float), 2)
    assert by_length.count() == 2
    with pytest.raises(ValueError):
        rerank.rerank("unknown", docs)


def test_memo(spark):
    old = spark.createDataFrame([("a", 1, 10), ("b", 2, 20), ("c", 3, 30)], "cache_key string, result long, stored_at long")
    new = spark.createDataFrame([("d", 4, 40)], old.schema)
    assert {r.cache_key for r in memo.store(old, new, 3).collect()} == {"b", "c", "d"}
    assert memo.remove(old, new).count() == 3


def test_config_rules():
    assert sum(RetrievalConfig().weights().values()) == pytest.approx(1)
    with pytest.raises(ValueError):
        PathSettings(weight=-1)
    with pytest.raises(ValueError):
        FusionSettings(rrf_k=0)
    with pytest.raises(ValueError):
        RetrievalConfig({"vector": PathSettings(weight=0.0)})
    # Weights are renormalised after every change, so they depend on the order.
    w = preset("vector_focused").paths
    first = 0.7 / 1.3
    rest = [0.3 / 1.3, 0.2 / 1.3, 0.1 / 1.3]
    total = first + 0.2 + rest[1] + rest[2]
    v, k, s, c = first / total, 0.2 / total, rest[1] / total, rest[2] / total
    total = v + k + 0.1 + c
    assert w["vector"].weight == pytest.approx(v / total) and not w["content"].enabled
    assert preset("high_precision").fusion.rrf_k == 30
    assert preset("fast_retrieval").rerank.enabled is False
    assert RetrievalConfig.from_dict(preset("keyword_focused").to_dict()).weights() == pytest.approx(preset("keyword_focused").weights())
    with pytest.raises(ValueError):
        preset("none")


def test_config_file(tmp_path):
    path = str(tmp_path / "c.json")
    preset("balanced").save(path)
    assert RetrievalConfig.load(path) == preset("balanced")


def test_stage_table():
    changed = with_stage("fast", top_k=7)
    assert changed[0].top_k == 7 and STAGES[0].top_k == 5


def test_stages_stop_per_query(spark, sf):
    from corpusweir.catalog.fixtures import chunk_corpus, query_vectors
    from corpusweir.operators import analysis
    from corpusweir.plans.progressive import retrieve_progressive, start_stage

    corpus, queries = chunk_corpus(spark, sf), query_vectors(spark, sf)
    starts = {r.query_id: r.s for r in analysis.analyse(queries).select(
        "query_id", start_stage(F.col("complexity"), F.col("confidence")).alias("s")).collect()}
    # Thresholds that everything meets: every query stays in its first stage.
    easy = with_stage("standard", with_stage("fast", threshold=0.0), threshold=0.0)
    rows = retrieve_progressive(corpus, queries, top=3, stages=easy).collect()
    assert {r.query_id: r.stage_number for r in rows} == starts
    assert max(r["rank"] for r in rows) == 3
    # Thresholds nothing meets: all stages run and each query keeps its best one.
    hard = with_stage("standard", with_stage("fast", threshold=2.0), threshold=2.0)
    rows = retrieve_progressive(corpus, queries, top=3, max_stage="standard", stages=hard).collect()
    assert {r.stage_reached for r in rows} == {1} and {r.query_id for r in rows} == set(starts)


def test_normalised_lists_may_be_shuffled(spark, monkeypatch):
    rows = [("q", d, float(d % 7)) for d in range(50)]
    df = spark.createDataFrame(rows, "q string, d long, score double")
    monkeypatch.setattr(normalise, "bounded_broadcast", lambda x: x)
    got = {r.d: r.norm for r in normalise.min_max(df, ["q"]).collect()}
    assert got == {d: s / 6 for _, d, s in rows}


def test_switch_options(spark):
    kids = spark.createDataFrame([(1, 1, "a", "p", "ca"), (1, 2, "b", "p", "cb"), (1, 3, "c", "x", "cc"), (1, 4, "d", None, "cd")],
                                 "query_id long, rank long, doc_id string, parent_id string, content string")
    big = spark.createDataFrame([("p", "whole", "sum", "kw")], "parent_id string, content string, summary string, keywords string")
    def rows(**kw):
        return [(r.doc_id, r.content) for r in parents.switch_to_parents(kids, big, **kw).orderBy("rank").collect()]

    assert rows() == [("a", "whole"), ("b", "whole")]
    assert rows(unique=True) == [("a", "whole")]
    assert rows(preserve=True) == [("a", "whole"), ("b", "whole"), ("c", "cc"), ("d", "cd")]
    assert rows(preserve=True, unique=True) == [("a", "whole"), ("c", "cc"), ("d", "cd")]
    stats = parents.switch_stats(kids, big, preserve=True).first()
    assert (stats.total_processed, stats.parent_chunks_found, stats.parent_chunks_missing, stats.small_chunks_kept) == (4, 2, 1, 2)


def test_inherited_fields_rank_like_rows_of_the_children(spark):
    from corpusweir.operators.inherited import InheritedSearch

    rows = []
    for doc, n in ((0, 3), (1, 12), (10, 4), (None, 2)):
        for i in range(n):
            parent = "-".join(str(x) for x in (doc, i) if x is not None)
            for j in range(1 + i % 4):
                rows.append((f"{parent}-{j}", parent, f"alpha{i % 3} beta own{j} own{j % 2}", f"lead alpha{i % 3} gamma", f"key{i % 2} alpha1"))
    children = spark.createDataFrame(rows, "doc_id string, parent_id string, content string, summary string, keywords string")
    above = children.groupBy("parent_id").agg(F.count("*").alias("n_children"), F.first("keywords").alias("keywords"), F.first("summary").alias("summary"))
    queries = spark.createDataFrame([(1, "alpha1 own1"), (2, "lead gamma key0"), (3, "alpha2"), (4, "nothing")], "query_id long, text string")
    limits = {"keywords": 7, "summary": 5, "content": 6}
    got = InheritedSearch.build(children, above, ("content",), ("keywords", "summary")).search(queries, limits)
    expected = bm25.search_fields(bm25.field_rows(children, {f: f for f in limits}), queries, limits)
    columns = ["query_id", "field", "rank", "doc_id", "score"]
    found = sorted(got.select(*columns).collect())
    assert found and found == sorted(expected.select(*columns).collect())


def test_terms_of_a_batch_are_counted_before_they_are_shuffled(spark):
    data = [("own", t, 1) for _, t in DOCS] + [("above", t, 1 + i % 3) for i, t in DOCS]
    rows = spark.createDataFrame(data, "field string, line string, n long").coalesce(1)
    got = bm25.line_terms(rows)
    expected = {}
    for field, line, n in data:
        for term in {*line.split(), ""}:
            df, total = expected.get((field, term), (0, None if term else 0))
            expected[field, term] = (df + n, total if term else total + n * len(line.split()))
    assert {(r.field, r.term): (r.df, r.total_dl) for r in got.collect()} == expected
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()


def test_terms_that_many_queries_name_score_alike(spark, monkeypatch):
    rows = bm25.field_rows(spark.createDataFrame(DOCS, "doc_id long, text string"), {"content": "text"})
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    found = []
    for by, most in ((4, 256), (1, 256), (2, 3), (100, 256)):
        monkeypatch.setattr(bm25, "SHARED_BY", by)
        monkeypatch.setattr(bm25, "SHARED_TERMS", most)
        weights = bm25.QueryWeights.collect(bm25.weighted_terms(bm25.query_terms(queries), bm25.corpus_stats(bm25.tokenised(rows)), True))
        columns, matrix = weights.shared_terms(0)
        assert len(matrix) == min(most, (np.diff(weights.starts) >= by).sum()) == (columns >= 0).sum()
        lists = [t.split() for _, t in DOCS]
        doc = np.repeat(np.arange(len(DOCS)), [len(t) for t in lists])
        place = {t: i for i, t in enumerate(weights.terms.to_pylist())}
        flat = [place.get(t, -1) for words in lists for t in words]
        hit = np.array(flat) >= 0
        counted = bm25._term_counts(doc[hit], np.array(flat)[hit], None, len(place))
        dl = np.array([len(t) for t in lists])
        scores = bm25._score_block(weights, 0, (columns, matrix), len(DOCS), *counted, dl, bm25.K1, bm25.B)
        found.append(scores[:, np.argsort(weights.query_ids)])
    for other in found[1:]:
        assert np.allclose(found[0], other, rtol=0, atol=2e-9)
    expected = [okapi(DOCS, text) for _, text in sorted(QUERIES)]
    assert all(abs(found[0][i, q] - scores.get(i, 0.0)) < 1e-6 for q, scores in enumerate(expected) for i in range(len(DOCS)))


def test_chunk_tables_are_written_only_when_asked_for(spark, tmp_path, monkeypatch):
    from corpusweir.catalog import fixtures

    spark.createDataFrame([(1, "One two three four five. " * 90), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    written = []
    monkeypatch.setattr(fixtures, "written_table", lambda df: written.append(df) or df)
    corpus = fixtures.chunk_corpus(spark, str(tmp_path))
    assert corpus.bare_parents.count() == 3 and corpus.bare_children.count() == 9 and not written
    assert {r.keywords for r in corpus.parents.collect()} == {"three four five"} and len(written) == 1
