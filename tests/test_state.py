"""Ordered computations, replays, streams, sources and table operations."""

import random
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusweir.operators import audit, context, keywords, metrics, ordering, relational
from corpusweir.session import bounded_broadcast, lookup_join
from corpusweir.plans import ingest
from corpusweir.sources import files, models, tables
from corpusweir.streaming import sinks, source, stateful

random.seed(3)
START = datetime(2024, 1, 1)
# One key holds most rows, so it has to span several segments.
EVENTS = [(i, "hot" if random.random() < 0.7 else random.choice("ab"), round(random.random() * 100, 2)) for i in range(900)]


def events(spark):
    return spark.createDataFrame(EVENTS, "id long, k string, v double")


def by_key():
    out = {}
    for i, k, v in EVENTS:
        out.setdefault(k, []).append((i, v))
    return out


def test_positions_over_segments(spark):
    got = {(r.k, r.id): r.position for r in ordering.positions(events(spark), ["k"], [F.col("id")]).collect()}
    assert got == {(k, i): n for k, rows in by_key().items() for n, (i, _) in enumerate(rows, 1)}


def test_percentiles_use_the_floor_index(spark):
    got = {r.k: (r.p50, r.p95) for r in ordering.floor_percentiles(events(spark), ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    for k, rows in by_key().items():
        s = sorted(v for _, v in rows)
        assert got[k] == (s[min(int(len(s) * 0.5), len(s) - 1)], s[min(int(len(s) * 0.95), len(s) - 1)])


def test_ewma_and_running_mean(spark):
    smooth = {r.id: r.ewma for r in ordering.ewma(events(spark), ["k"], ["id"], "v").collect()}
    mean = {r.id: r.running_mean for r in ordering.running_mean(events(spark), ["k"], [F.col("id")], "v").collect()}
    for rows in by_key().values():
        e = total = 0.0
        for n, (i, v) in enumerate(rows, 1):
            e, total = 0.9 * e + 0.1 * v, total + v
            assert smooth[i] == pytest.approx(e) and mean[i] == pytest.approx(total / n)


def test_breaker_replay_matches_one_pass(spark):
    at, rows = START, []
    for i in range(400):
        at += timedelta(seconds=random.choice([1, 5, 20, 70]))
        rows.append((i, random.choice("xy"), at, random.random() < 0.6))
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp, failed boolean")
    got = {r.id: (r.state, r.failure_count, r.admitted) for r in
           metrics.replay_breaker(df, ["k"], "ts", "id", "failed", 3, 60.0).collect()}
    for k in "xy":
        state = ("closed", 0, 0.0)
        for i, kk, ts, failed in rows:
            if kk == k:
                state, admitted = metrics.breaker_step(state, ts.timestamp(), failed, 3, 60.0)
                assert got[i] == (state[0], state[1], admitted)


def test_breaker_opens_and_recovers():
    state = ("closed", 0, 0.0)
    for t in range(5):
        state, _ = metrics.breaker_step(state, t, True, 5, 60)
    assert state[0] == "open"
    state, admitted = metrics.breaker_step(state, 10, False, 5, 60)
    assert state[0] == "open" and not admitted
    state, admitted = metrics.breaker_step(state, 64, False, 5, 60)
    assert state == ("closed", 0, 4) and admitted


def test_rolling_frame_matches_direct(spark):
    rows = [(i, "k", START + timedelta(seconds=random.randint(0, 20000)), float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp, v double")
    got = {r.id: (r.rolling_count, r.rolling_max) for r in metrics.rolling(df, ["k"], "ts", "v", 900).collect()}
    for i, _, ts, _ in rows:
        frame = [v for _, _, t, v in rows if ts - timedelta(seconds=900) <= t <= ts]
        assert got[i] == (len(frame), max(frame))


def test_status_priority(spark):
    for states, want in [(["healthy"], "healthy"), (["healthy", "degraded"], "degraded"), (["degraded", "unhealthy"], "unhealthy"), ([], "unknown")]:
        df = spark.createDataFrame([(s,) for s in states], "status string")
        assert metrics.system_status(df).first().overall_status == want


# ------------------------------------------------------------------------------ streams


def test_progress_relay_stops_at_the_end(spark, tmp_path):
    rows = [("d1", 1, START, "processing"), ("d1", 2, START + timedelta(seconds=65), "chat_ready"),
            ("d1", 3, START + timedelta(seconds=66), "late"), ("d2", 4, START, "processing"),
            ("d2", 5, START + timedelta(seconds=400), "processing")]
    schema = "document_id string, id long, timestamp timestamp, status string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = source.files(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    out = source.run_available(stateful.progress_relay(stream, "document_id", "timestamp", "id", "status", source.TERMINAL))
    got = {}
    for r in out.orderBy("document_id", "seq").collect():
        got.setdefault(r.document_id, []).append(r.status)
    assert got["d1"] == ["connected", "processing", "heartbeat", "heartbeat", "chat_ready"]
    assert got["d2"] == ["connected", "processing"] + ["heartbeat"] * 10 + ["timeout"]


def test_messages_round_trip(spark):
    df = spark.createDataFrame([("d", "processing", 30, "m", START)], source.MESSAGE)
    back = source.parse_messages(source.to_messages(df)).first()
    assert (back.document_id, back.progress, back.timestamp) == ("d", 30, START)


def test_vectorise_is_incremental(spark, tmp_path):
    path, inbox = str(tmp_path / "vectors"), str(tmp_path / "in")
    embed = lambda df: models.embed(df, "text", models.hashed_embedder(8))
    state = str(tmp_path / "state")
    for ids in ([1, 2], [2, 3]):
        spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").coalesce(1).write.mode("append").parquet(inbox)
        stream = source.files(spark, inbox, "doc_id long, text string")
        source.run_batches(stream, sinks.vectorise(path, embed), state)
    assert sorted(r.doc_id for r in spark.read.parquet(path).collect()) == [1, 2, 3]


# ------------------------------------------------------------------------------ sources


def docx(path):
    body = ('<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p>'
            '<w:p><w:r><w:t>Body text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc>'
            '<w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", body)


def test_files_to_elements(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain 文本", encoding="utf-8")
    (tmp_path / "b.md").write_text("# Head\nintro\n\n- one\n- two\n\n| a | b |\n| 1 | 2 |", encoding="utf-8")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "x.exe").write_bytes(b"1")
    docx(tmp_path / "c.docx")
    with zipfile.ZipFile(tmp_path / "d.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="s"><si><t>name</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="s"><sheetData><row><c t="s"><v>0</v></c><c><v>3</v></c></row></sheetData></worksheet>')
    with zipfile.ZipFile(tmp_path / "e.pptx", "w") as z:
        z.writestr("ppt/slides/slide1.xml", '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:ph type="title"/><a:p><a:t>Deck</a:t></a:p></p:sp></p:sld>')
    good, bad = files.parse_files(files.read_files(spark, str(tmp_path)))
    rows = [(r.path.rsplit("/", 1)[-1], r.type, r.text) for r in good.orderBy("path", "position").collect()]
    assert rows == [
        ("a.txt", "NarrativeText", "plain 文本"), ("b.md", "Title", "Head"), ("b.md", "NarrativeText", "intro"),
        ("b.md", "ListItem", "- one"), ("b.md", "ListItem", "- two"), ("b.md", "Table", "| a | b |\n| 1 | 2 |"),
        ("c.docx", "Title", "Head"), ("c.docx", "NarrativeText", "Body text"), ("c.docx", "Table", "a | b"),
        ("d.xlsx", "Table", "name | 3"), ("e.pptx", "Title", "Deck")]
    assert {r.path.rsplit("/", 1)[-1] for r in bad.collect()} == {"bad.docx", "x.exe"}
    assert files.read_text_files(spark, str(tmp_path / "a.txt")).first().text == "plain 文本"


def test_files_through_cleaning_standardising_and_splitting(spark, tmp_path):
    folder = tmp_path / "in" / "deeper"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_text("Vol. 3\n患者 心肌梗塞 history of pain\n" + "word after word goes on. " * 120, encoding="utf-8")
    (tmp_path / "in" / "b.md").write_text("# A heading of the text\n\n- one item of a list\n- one item of a list", encoding="utf-8")
    (folder / "notes.log").write_text("a log that is only text", encoding="utf-8")
    (folder / "bad.docx").write_bytes(b"no zip\0")
    (folder / "empty.txt").write_text("", encoding="utf-8")
    docx(folder / "c.docx")
    done = ingest.ingest_files(spark, str(tmp_path / "in"))
    name = lambda r: r.path.rsplit("/", 1)[-1]
    docs = {name(r): r for r in done.documents.collect()}
    assert set(docs) == {"a.txt", "b.md", "c.docx", "notes.log"} and docs["c.docx"].text == "Head\n\nBody text\n\na | b"
    bad = {name(r): r.error for r in done.rejects.collect()}
    assert set(bad) == {"bad.docx"} and "BadZipFile" in bad["bad.docx"]
    parents = done.ingested.parents.collect()
    long = sorted((p for p in parents if p.doc_id == docs["a.txt"].doc_id), key=lambda p: p.parent_index)
    assert len(long) > 1 and long[0].content.startswith("患者 心肌梗死 history of pain word") and all(len(p.content) <= 1024 for p in long)
    assert [p.content for p in parents if p.doc_id == docs["b.md"].doc_id] == ["A heading of the text - one item of a list"]
    assert {c.parent_id for c in done.ingested.children.collect()} == {p.parent_id for p in parents}
    strict = ingest.ingest_files(spark, str(tmp_path / "in"), fallback=False)
    assert {name(r) for r in strict.rejects.collect()} == {"bad.docx", "notes.log"}


def test_rejects_carry_reasons(spark):
    df = spark.createDataFrame([("q", 5), ("", 5), ("q", 99)], "query string, max_results int")
    good, bad = tables.checked(df, tables.RULES["queries"])
    assert good.count() == 1 and {r.reject_reasons[0] for r in bad.collect()} == {"query length outside 1..1000", "max_results outside 1..20"}
    kw = spark.createDataFrame([(["a", "b"], [0.5]), (["a"], [0.5])], "keywords array<string>, keyword_scores array<double>")
    assert tables.checked(kw, tables.RULES["keywords"])[1].count() == 1


def test_tables_and_migration(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS weir_test")
    tables.create_tables(spark, str(tmp_path / "db"), "weir_test")
    assert {r.table_name for r in tables.table_overview(spark, "weir_test").collect()} == set(tables.SCHEMAS)
    spark.sql("DROP DATABASE weir_test CASCADE")
    old = spark.createDataFrame([("1", "old")], "id string, title string")
    new = spark.createDataFrame([("1", "new"), ("2", "b")], "id string, title string")
    moved = tables.migrate({"sessions": new, "chat_history": new}, {"sessions": old, "chat_history": old})
    assert sorted(map(tuple, moved["sessions"].collect())) == [("1", "new"), ("2", "b")]
    assert moved["chat_history"].count() == 3
    assert "vectorized" in tables.add_missing_columns(old, "documents").columns


def test_orphan_guard(spark):
    vecs = spark.createDataFrame([("d1",), (None,)], "document_id string")
    with pytest.raises(ValueError):
        relational.remove_orphans(vecs, vecs.limit(0), dry_run=False)
    valid = spark.createDataFrame([("d2",)], "document_id string")
    assert relational.orphans(vecs, valid).count() == 2
    assert relational.orphans(vecs, valid, null_is_orphan=False).count() == 1


def test_keyword_views(spark):
    df = spark.createDataFrame([(["a", "b", "c"], [0.2, 0.9, 0.9])], "k array<string>, s array<double>")
    best = df.select(keywords.top_scored(F.col("k"), F.col("s"), 2).alias("t")).first().t
    assert [(x.keyword, x.score) for x in best] == [("b", 0.9), ("c", 0.9)]
    raw = spark.createDataFrame([('["a", "b"]',), ("a, b ,",)], "k string")
    assert [r[0] for r in raw.select(relational.keyword_list(F.col("k"))).collect()] == [["a", "b"], ["a", "b"]]


def test_models(spark):
    cands = spark.createDataFrame([(1, "q", "doc1", "x"), (1, "q", "doc2", "y"), (1, "q", "doc3", " ")],
                                  "query_id long, query string, doc_id string, content string")
    client = lambda: lambda q, docs: [(i, 1.0 - i / 10) for i in range(len(docs))]
    assert models.rerank_scores(cands, client).count() == 2
    echo = models.generate(cands, "content", lambda: lambda ps: [p + "!" for p in ps])
    assert {r.response for r in echo.collect()} == {"x!", "y!", " !"}
    got = cands.select(models.canned_response(F.lit("我有糖尿病"), {"diabetes": "d"}, "general")).first()[0]
    assert got == "d"
    emb = models.embed(cands.withColumn("content", F.lit("")), "content", models.hashed_embedder())
    assert emb.first().embedding == []


def test_context_block(spark):
    rows = spark.createDataFrame([(1, 2, "s2", 0.5, "two"), (1, 1, None, 0.9, "one")],
                                 "query_id long, rank long, source string, relevance double, content string")
    got = context.assemble(rows).first()
    assert got.context == "1 (来源: 未知, 相关度: 0.900):\none\n\n2 (来源: s2, 相关度: 0.500):\ntwo\n"
    assert got.confidence_score == pytest.approx(0.7)


def test_audit(spark):
    df = spark.createDataFrame([("f.py", "# http://skip\nurl = 'http://x'\nv = os.getenv('A_B')\n# TODO: later")], "path string, text string")
    rows = audit.lines(df, "path", "text")
    assert [(r.line_no, r.finding) for r in audit.hard_coded(rows).collect()] == [(2, "http url")]
    assert audit.open_tasks(rows).first().line_no == 4
    env = audit.lines(spark.createDataFrame([("e", "C_D=1")], "path string, text string"), "path", "text")
    assert [r.name for r in audit.undeclared(rows, env).collect()] == ["A_B"]


def test_lookup_join_beyond_the_bound(spark):
    rows, big = spark.range(50).withColumnRenamed("id", "k"), spark.range(100).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert bounded_broadcast(rows, 10) is rows
    assert lookup_join(rows, big, "k").count() == 50


def test_upsert_takes_the_newest_change_of_a_key(spark):
    from corpusweir.operators.relational import upsert

    base = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, at int")
    changes = spark.createDataFrame([(1, "c", 1), (1, "d", 2), (3, "e", 1)], "k int, v string, at int")
    assert sorted(tuple(r) for r in upsert(base, changes, "k", "at").collect()) == [(1, "d", 2), (2, "b", 0), (3, "e", 1)]
