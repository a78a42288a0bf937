"""Versioned tables, rolling frames, page ranges, frequent terms and configuration search beside brute force."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusweir.operators import elements, keywords, metrics
from corpusweir.plans import retrieval as plan
from corpusweir.config import preset
from corpusweir.sources.commits import CommitLog
from corpusweir.sources.versioned import Store, delete_documents, migrate_into

TABLES = {"documents": ("id long, text string", "id"), "chunks": ("cid string, id long", "id"), "log": ("id long, note string", "id")}


@pytest.fixture
def store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), TABLES, buckets=4)
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "id long, text string")
    chunks = spark.createDataFrame([(f"{i}-{j}", i) for i in range(20) for j in range(i % 3)], "cid string, id long")
    log = spark.createDataFrame([(1, "a"), (1, "a")], "id long, note string")
    migrate_into(store, {"documents": docs, "chunks": chunks, "log": log}, ("log",))
    return store


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_changes_by_key_and_appends(spark, store):
    more = spark.createDataFrame([(3, "new"), (99, "added")], "id long, text string")
    migrate_into(store, {"documents": more, "log": spark.createDataFrame([(1, "a")], "id long, note string")}, ("log",))
    wanted = {i: f"t{i}" for i in range(20)} | {3: "new", 99: "added"}
    assert rows(store.read("documents")) == sorted(wanted.items())
    assert rows(store.read("log")) == [(1, "a")] * 3
    assert rows(store.read("documents", 1)) == sorted((i, f"t{i}") for i in range(20))
    # Only buckets that hold changed keys are new files.
    before, after = (store.log.version(n).content["tables"]["documents"] for n in (1, 2))
    touched = {str(r[0]) for r in more.select(F.pmod(F.xxhash64("id"), F.lit(4))).collect()}
    assert {b for b in after if before.get(b) != after[b]} <= touched and len(touched) < 4


def test_a_deletion_that_ends_half_way_changes_nothing(spark, store, monkeypatch):
    ids = spark.createDataFrame([(i,) for i in (2, 5, 8, 77, None)], "id long")
    before = {name: rows(store.read(name)) for name in TABLES}
    written, ended = CommitLog.new_part, []

    def second_write_ends(self):
        ended.append(1)
        if len(ended) == 2:
            raise RuntimeError("executor lost")
        return written(self)

    with monkeypatch.context() as m:
        m.setattr(CommitLog, "new_part", second_write_ends)
        with pytest.raises(RuntimeError, match="executor lost"):
            delete_documents(store, ids)
    assert {name: rows(store.read(name)) for name in TABLES} == before
    delete_documents(store, ids)
    assert {r[0] for r in rows(store.read("documents"))} == set(range(20)) - {2, 5, 8}
    assert not {r[1] for r in rows(store.read("chunks"))} & {2, 5, 8}
    assert rows(store.read("chunks", 1)) == before["chunks"]


def test_the_loser_of_a_race_works_on_the_winners_version(spark, store):
    other = Store(spark, store.log.path, TABLES, buckets=4)
    calls = []

    def work(change):
        calls.append(change.base.number)
        if len(calls) == 1:
            migrate_into(other, {"documents": spark.createDataFrame([(1, "first")], "id long, text string")}, ())
        change.upsert("documents", spark.createDataFrame([(2, "second")], "id long, text string"))

    store.commit(work)
    assert calls == [1, 2]
    now = dict(rows(store.read("documents")))
    assert now[1] == "first" and now[2] == "second" and len(now) == 20


def test_rolling_frames_with_one_hot_component(spark):
    r, start = random.Random(1), datetime(2024, 1, 1)
    events = [(i, "hot" if i % 3 == 0 else f"c{i % 7}", start + timedelta(seconds=r.randint(0, 4000) if i % 2 else 600 * r.randint(0, 6)),
               None if i % 11 == 0 else r.randint(0, 100) / 4) for i in range(900)]
    df = spark.createDataFrame(events, "id long, k string, ts timestamp, v double")
    got = {x.id: (x.rolling_count, x.rolling_avg, x.rolling_max) for x in metrics.rolling(df, ["k"], "ts", "v", 600).collect()}
    for i, k, ts, _ in events:
        frame = [v for _, kk, t, v in events if kk == k and ts - timedelta(seconds=600) <= t <= ts]
        known = [v for v in frame if v is not None]
        assert got[i][0] == len(frame) and got[i][2] == (max(known) if known else None)
        assert got[i][1] == (pytest.approx(sum(known) / len(known)) if known else None)


def test_rolling_frames_are_visited_twice_only(spark):
    df = spark.createDataFrame([(1, "a", datetime(2024, 1, 1), 1.0)], "id long, k string, ts timestamp, v double")
    plan_text = metrics.rolling(df, ["k"], "ts", "v", 600)._jdf.queryExecution().executedPlan().toString()
    assert "-600000000" not in plan_text and "unboundedpreceding" in plan_text


def test_pages_of_chunks(spark):
    r = random.Random(2)
    docs = [(1, "\n".join("x" * r.randint(0, 300) for _ in range(200))), (2, ""), (3, "one"), (4, None), (5, "y" * 30000)]
    pages = elements.text_pages(spark.createDataFrame(docs, "d long, t string"), "d", "t", lines=7)
    held = pages.collect()
    chunks = []
    for d, t in docs:
        at = 0
        while t and at < len(t):
            n = r.randint(1, 5000)
            chunks.append((d, len(chunks), at, min(len(t), at + n)))
            at += n
    chunks.append((1, 9999, 10**7, 10**7 + 5))
    frame = spark.createDataFrame(chunks, "d long, c int, start long, end long")
    for stretch in (64, 4096):
        got = {x.c: (x.first_page, x.last_page, x.page_range) for x in elements.spanned_pages(frame, pages, "d", ["c"], stretch).collect()}
        for d, c, s, e in chunks:
            met = [p.page_number for p in held if p.d == d and s < p.end and p.start < e]
            assert got[c] == ((min(met), max(met), f"{min(met)}-{max(met)}") if met else (None, None, None))


def test_frequent_terms_as_counted_one_by_one(spark):
    r = random.Random(3)
    docs = [(i, None if i == 3 else [r.choice("abcdefgé") * r.randint(1, 3) for _ in range(r.choice([0, 1, 5, 200]))]) for i in range(60)]
    docs[7] = (7, ["x", None, "y", None, "y"])
    df = spark.createDataFrame(docs, "id long, terms array<string>")
    for n in (3, None):
        got = sorted((x.id, x.rank, x.term, x.n, x.first_pos) for x in keywords.frequent_terms(df, ["id"], n).collect())
        wanted = []
        for i, terms in docs:
            count = Counter(t for t in terms or [] if t is not None)
            best = sorted(count, key=lambda t: (-count[t], terms.index(t)))[:n]
            wanted += [(i, k + 1, t, count[t], terms.index(t)) for k, t in enumerate(best)]
        assert got == sorted(wanted)


def test_presets_side_by_side_as_one_by_one(spark):
    r = random.Random(4)
    lists = [(q, p, k + 1, f"d{d}", f"p{d % 40}" if d % 9 else None, float(50 - k)) for q in range(3) for p in ("vector", "keywords", "summary", "content")
             for k, d in enumerate(r.sample(range(120), 50))]
    df = spark.createDataFrame(lists, "query_id long, path string, rank long, doc_id string, parent_id string, score double")
    configs = {name: preset(name) for name in ("balanced", "vector_focused", "keyword_focused", "fast_retrieval", "high_precision")}
    got = plan.fused_under(df, configs, 10)
    for name, config in configs.items():
        cut = df.filter(" or ".join(f"path = '{p}' and rank <= {k}" for p, k in config.top_ks().items()))
        one = plan.fused_candidates(cut, config, top=10).select("query_id", "doc_id", "rank", "fusion_score")
        assert rows(got.filter(F.col("preset") == name).select("query_id", "doc_id", "rank", "fusion_score")) == rows(one)


def test_configurations_by_latency_and_success(spark):
    runs = [("a", 100.0, False), ("a", 300.0, False), ("b", 50.0, True), ("c", 5000.0, False), ("d", 100.0, False), ("d", 9e9, True)]
    out = metrics.configuration_scores(spark.createDataFrame(runs, "c string, ms double, bad boolean"), "c", "ms", F.col("bad"), 1000.0)
    assert [(x.c, x.rank, round(x.score, 6)) for x in out.orderBy("rank").collect()] == [("a", 1, 88.0), ("d", 2, 74.0), ("c", 3, 40.0), ("b", 4, 0.0)]
