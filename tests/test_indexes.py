"""Stored indexes: growth, deletion, unfinished and competing writers, pruned reads, recall."""

import numpy as np
import pytest

from corpusweir.operators import bm25
from corpusweir.operators.stored_index import StoredIndex
from corpusweir.operators.vector import vector_topk
from corpusweir.operators.vector_index import VectorIndex
from corpusweir.sources.commits import CommitLog, LostRace

WORDS = [f"w{i}" for i in range(300)]


def rows_of(spark, docs):
    return spark.createDataFrame([(i, "text", t) for i, t in docs.items()], "doc_id long, field string, text string")


@pytest.fixture(scope="module")
def docs():
    r = np.random.RandomState(1)
    return {i: " ".join(WORDS[w] for w in r.zipf(1.4, r.randint(0, 60)) % 300) for i in range(200)}


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "w1 w2 w2"), (2, "w7 w250"), (3, "nothing"), (4, "")], "query_id long, text string")


def ranked(df):
    return sorted(tuple(r) for r in df.select("query_id", "field", "rank", "doc_id", "score").collect())


def test_a_grown_index_searches_as_a_rebuilt_one(spark, docs, queries, tmp_path):
    index = StoredIndex(spark, str(tmp_path / "index"))
    now = {}
    steps = [
        ("add", {i: docs[i] for i in range(80)}), ("add", {i: docs[i] for i in range(80, 160)}), ("drop", [3, 90, 999]),
        ("put", {5: "w1 w1 w1 fresh", 90: "w7 again", 300: docs[170]}), ("drop", [5, 90]), ("put", {3: docs[4]}), ("compact", None),
        ("add", {i: docs[i] for i in range(160, 200)}), ("put", {0: ""}),
    ]
    for step, what in steps:
        if step == "compact":
            index.compact()
            assert index.log.vacuum() > 0
        elif step == "drop":
            index.delete(spark.createDataFrame([(i,) for i in what], "doc_id long"))
            now = {i: t for i, t in now.items() if i not in what}
        else:
            index.append(rows_of(spark, what), replace=step == "put")
            now |= what
        assert ranked(index.search(queries, 7)) == ranked(bm25.search_fields(rows_of(spark, now), queries, 7)), step


def test_a_search_reads_only_its_terms(spark, docs, tmp_path):
    index = StoredIndex(spark, str(tmp_path / "index"))
    index.append(rows_of(spark, docs))
    plan = index.hits(["w1", "w2"])._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [w1,w2])" in plan
    assert index.hits([]).count() == 0


def test_more_terms_than_are_pushed(spark, docs, queries, tmp_path, monkeypatch):
    monkeypatch.setattr("corpusweir.operators.stored_index.PRUNED_TERMS", 1)
    index = StoredIndex(spark, str(tmp_path / "index"))
    index.append(rows_of(spark, docs))
    assert ranked(index.search(queries, {"text": 5})) == ranked(bm25.search_fields(rows_of(spark, docs), queries, 5))


def test_an_empty_index_and_an_empty_batch(spark, queries, tmp_path):
    index = StoredIndex(spark, str(tmp_path / "index"))
    assert index.search(queries, 5).count() == 0
    index.append(rows_of(spark, {1: "w1"}).limit(0))
    assert index.search(queries, 5).count() == 0
    index.append(rows_of(spark, {1: "w1"}))
    with pytest.raises(ValueError, match="more than once"):
        index.append(rows_of(spark, {2: "w1"}).union(rows_of(spark, {2: "w2"})))


def test_an_unfinished_write_leaves_the_old_version_whole(spark, docs, queries, tmp_path, monkeypatch):
    index = StoredIndex(spark, str(tmp_path / "index"))
    index.append(rows_of(spark, {i: docs[i] for i in range(50)}))
    before, version = ranked(index.search(queries, 5)), index.log.latest().number

    def ended(self, number, content):
        raise RuntimeError("the writer ended here")

    with monkeypatch.context() as m:
        m.setattr(CommitLog, "publish", ended)
        with pytest.raises(RuntimeError, match="ended here"):
            index.append(rows_of(spark, {i: docs[i] for i in range(50, 90)}))
    assert index.log.latest().number == version and ranked(index.search(queries, 5)) == before
    assert index.log.vacuum() >= 4 and ranked(index.search(queries, 5)) == before


def test_the_second_of_two_writers_loses_and_tries_again(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    log.publish(1, {"rows": ["a"]})
    with pytest.raises(LostRace):
        log.publish(1, {"rows": ["b"]})
    seen = []

    def change(base):
        seen.append(base.number)
        if len(seen) == 1:
            CommitLog(spark, str(tmp_path / "log")).publish(2, {"rows": [*base.content["rows"], "other"]})
        return {"rows": [*base.content["rows"], "mine"]}

    assert log.commit(change).content == {"rows": ["a", "other", "mine"]} and seen == [1, 2]
    assert log.version(1).content == {"rows": ["a"]}


@pytest.fixture(scope="module")
def clustered(spark):
    r = np.random.RandomState(2)
    centres = r.normal(size=(30, 24))
    x = centres[r.randint(0, 30, 3000)] + r.normal(size=(3000, 24)) * 0.6
    x[:600] = x[0] + r.normal(size=(600, 24)) * 0.01  # a fifth of all in one cell
    x[600:700] = x[600]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(9000, None), (9001, [0.0] * 24)]
    vectors = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    q = centres[r.randint(0, 30, 40)] + r.normal(size=(40, 24)) * 0.6
    q[0] = x[600]
    asked = [(i, [float(v) for v in row]) for i, row in enumerate(q)] + [(99, None)]
    return vectors, spark.createDataFrame(asked, "query_id long, embedding array<double>")


def hits(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


def test_exact_search_of_stored_vectors_is_a_full_scan(spark, clustered, tmp_path, monkeypatch):
    monkeypatch.setattr("corpusweir.operators.vector_index.ROW_BLOCK", 100)
    monkeypatch.setattr("corpusweir.operators.vector_index.QUERY_BLOCK", 7)
    vectors, asked = clustered
    index = VectorIndex(spark, str(tmp_path / "v")).build(vectors)
    scan = vector_topk(vectors.filter("doc_id < 9000"), asked, 12)
    for probes in (1, 6):
        assert hits(index.search(asked, 12, probes=probes)) == hits(scan)
    best = hits(index.search(asked, 12, min_score=0.9))
    assert best == [h for h in hits(scan) if h[3] >= 0.9]


def test_probed_search_finds_nine_of_ten(spark, clustered, tmp_path):
    vectors, asked = clustered
    index = VectorIndex(spark, str(tmp_path / "v")).build(vectors, cells=30)
    true = {h[:1] + h[2:3] for h in hits(index.search(asked, 10))}
    found = {h[:1] + h[2:3] for h in hits(index.search(asked, 10, probes=4, exact=False))}
    assert len(true & found) >= 0.9 * len(true)
    empty = VectorIndex(spark, str(tmp_path / "none")).build(vectors.limit(0))
    assert empty.search(asked, 3).count() == 0


def test_large_query_sets_meet_vectors_in_blocks(spark, clustered, monkeypatch):
    monkeypatch.setattr("corpusweir.operators.vector.VECTOR_BLOCK", 500)
    vectors, asked = clustered
    vectors = vectors.filter("doc_id < 9000")
    assert hits(vector_topk(vectors, asked, 5, query_block=8)) == hits(vector_topk(vectors, asked, 5))
