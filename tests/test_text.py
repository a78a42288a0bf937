"""Text operators: literal cases and brute force on random texts."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusweir import lexicon as L
from corpusweir.functions import text as X
from corpusweir.operators import analysis, chunking, cleaning, elements, keywords, quality, terminology

random.seed(11)


def one(spark, text, column, **more):
    df = spark.createDataFrame([(text, *more.values())], ", ".join(f"{n} string" for n in ("text", *more)))
    return df.select(column.alias("r")).first().r


def sample(n=40):
    bits = ["the", "Of", "and\n", "高血压", "患者", "der.", "x!", "a b", "\n\n", "，", "wort", "1234", "\t", "ü"]
    return ["".join(random.choices(bits, k=random.randint(0, 60))) for _ in range(n)] + ["", " ", "abc"]


def test_entropy_and_repetition_match_python(spark):
    texts = sample()
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select("text", X.entropy(F.col("text")).alias("e"), X.repetition_ratio(F.col("text")).alias("r")).collect()
    for row in got:
        n = len(row.text)
        e = -sum(c / n * math.log2(c / n) for c in Counter(row.text.lower()).values()) if n else 0.0
        w = row.text.split()
        r = 0.0 if len(w) < 2 else sum(c - 1 for c in Counter(w).values()) / len(w)
        assert row.e == pytest.approx(e) and row.r == pytest.approx(r)


def test_language(spark):
    cases = {"高血压患者": "zh", "plain words": "en", "高血压 and words": "mixed", "": "unknown", "  ": "unknown"}
    for text, want in cases.items():
        assert one(spark, text, X.language(F.col("text"))) == want


def test_clean_literals(spark):
    for raw, want in [("这是  多余  空白", "这是 多余 空白"), ("这是\t制表符\n换行符", "这是 制表符 换行符"),
                      ("这是重复标点！！！", "这是重复标点！"), ("这是\t混合情况  ！！！\n\n", "这是 混合情况 ！"),
                      ("页００７Ａｂ", "页7Ab"), ("see http://x.y/z now", "see now"), ("a@b.com x", "x"), ("it's \"so\" ‘x’", "its \"so\" x"), ("", "")]:
        assert one(spark, raw, cleaning.clean_basic(F.col("text"))) == want


def test_clean_modes_differ_on_short_text(spark):
    df = spark.createDataFrame([("这是重复标点！！！",), ("first line of words\nfirst line of words\nsecond line of words",)], "text string")
    loose = [r.cleaned for r in cleaning.clean_steps(df).collect()]
    strict = [r.cleaned for r in cleaning.clean_steps(df, strict=True).collect()]
    assert loose[1] == "first line of words second line of words"
    assert strict[0] == "" and strict[1].count("first line") == 2


def test_headers(spark):
    text = "2020-01-02 issue\nVol. 3\nkept line\n中华医学杂志 x\nnot Vol. 3"
    assert one(spark, text, cleaning.drop_headers(F.col("text"))) == "kept line\nnot Vol. 3"


def test_abbreviations(spark):
    got = one(spark, "mi and AMI, xMI; 心梗", cleaning.expand_abbreviations(F.col("text")))
    assert got == "心肌梗死 and 急性心肌梗死, xMI; 心肌梗死"
    custom = one(spark, "ab-c d", cleaning.expand_abbreviations(F.col("text"), custom={"AB-C": "long"}))
    assert custom == "long d"


def test_repeated_lines_match_python(spark):
    texts = ["\n".join(random.choices(["a long enough line", "A long, enough line!", "other sentence here", "short"], k=9)) for _ in range(20)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for row in df.select("text", cleaning.drop_repeated_lines(F.col("text")).alias("r")).collect():
        seen, kept = set(), []
        for line in (x.strip() for x in row.text.split("\n")):
            key = re.sub(r"[\W]", "", line.lower())
            if line and len(key) >= 10 and key not in seen:
                seen.add(key)
                kept.append(line)
        assert row.r == "\n".join(kept)


def test_structure(spark):
    text = "一、标题\npara one\npara two\n\n- item\n1) second\n[1] ref\nALL CAPS\nlast"
    got = one(spark, text, cleaning.structure(F.col("text")))
    assert got == {"titles": ["一、标题", "ALL CAPS"], "lists": ["- item", "1) second"], "references": ["[1] ref"],
                   "paragraphs": ["para one para two", "last"]}


def test_references_and_title(spark):
    text = "中国高血压防治指南修订版\nbody\nReferences\n[1] First author, a title\n[2] Second author, b title"
    refs = one(spark, text, cleaning.references(F.col("text")))
    assert [(r.reference_id, r.reference_text) for r in refs] == [
        ("1", "[1] First author, a title"), ("2", "[2] Second author, b title")]
    assert one(spark, text, cleaning.title(F.col("text"), F.lit("file"))) == "中国高血压防治指南修订版"
    assert one(spark, "12\n", cleaning.title(F.col("text"), F.lit("file"))) == "file"


@pytest.mark.parametrize("line", [
    "４２１－４３４ Ｊｏｕｒｎａｌ of 诊断指南一二三四五", "Ｃｌｉｎｉｃａｌ 诊断和治疗指南一二三四五", "Ｃａｒｄ ｉｏｌｏｇｙ 诊断和治疗指南一二三四五",
    "２０１８年第３期 临床心血管病杂志指南一二三", "ｄｏｉ：１２３４５６７８９０", "Page\u300012 of the whole report",
])
def test_lines_that_are_no_title(spark, line):
    assert one(spark, line, cleaning.title(F.col("text"), F.lit("file"))) == "file"


def test_frequent_terms_in_the_row(spark):
    rows = [(1, ["b", "a", "b", "c", "a", "d"]), (2, []), (3, None), (4, ["x"])]
    df = spark.createDataFrame(rows, "k int, terms array<string>")

    def found(n):
        return [tuple(r) for r in keywords.frequent_terms(df, ["k"], n).orderBy("k", "rank").collect()]

    everything = [(1, "b", 2, 0, 1), (1, "a", 2, 1, 2), (1, "c", 1, 3, 3), (1, "d", 1, 5, 4), (4, "x", 1, 0, 1)]
    assert found(None) == everything
    assert found(2) == [r for r in everything if r[4] <= 2]


def test_standardise(spark):
    apply = terminology.standardiser()
    assert one(spark, "急性MI CHF", apply(F.col("text"))) == "急性心肌梗死 充血性心力衰竭"
    plain = terminology.standardiser(plain=True)
    assert "脑梗死" in one(spark, "患者脑梗塞入院", plain(F.col("text")))
    assert one(spark, " ", apply(F.col("text"))) == ""


def test_entities_and_validation(spark):
    text = "肺炎患者用阿司匹林, CT 检查; 心肌梗塞"
    found = {k: one(spark, text, c) for k, c in terminology.entity_classes(F.col("text")).items()}
    assert found["diseases"] == ["肺炎"] and found["drugs"] == ["阿司匹林"] and found["abbreviations"] == ["CT"]
    checks = {k: one(spark, text, c) for k, c in terminology.validate(F.col("text")).items()}
    assert "心肌梗塞" in checks["non_standard_terms"] and checks["missing_standardization"] == ["CT"]


def test_custom_dictionary(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text('{"standard_terms": {"foo": "bar"}, "synonyms": {"高血压": ["HBP"]}}', encoding="utf-8")
    d = terminology.Dictionary().extended(str(path))
    assert one(spark, "a foo b", terminology.standardiser(d)(F.col("text"))) == "a bar b"
    assert "HBP" in d.synonyms["高血压"]


def test_lexicon_sizes():
    assert (len(L.STANDARD_TERMS), len(L.ABBREVIATIONS), len(L.SYNONYMS), len(L.DRUGS), len(L.DISEASES), len(L.PROCEDURES)) == (
        57, 92, 10, 34, 10, 13)


def test_level_bands(spark):
    for score, want in [(0.9, "excellent"), (0.8, "excellent"), (0.7, "good"), (0.6, "good"), (0.4, "fair"), (0.1, "poor"), (None, "fair")]:
        assert spark.range(1).select(quality.level(F.lit(score).cast("double"))).first()[0] == want


def test_summary_scores(spark):
    original, summary = "这是一段很长的原始文本内容，包含很多详细信息", "这是摘要"
    df = spark.createDataFrame([(original, summary), ("", "x")], "text string, summary string")
    full, empty = quality.summary_quality(df).collect()
    assert full.compression_ratio == len(summary) / len(original) and full.length_score == len(summary) / 20
    assert empty.overall_score == 0.0 and empty.quality_level == "poor"
    high = one(spark, "心肌梗死、胸痛、心电图、肌钙蛋白", quality.information_density(F.col("text")))
    low = one(spark, "普通 普通 文本 文本", quality.information_density(F.col("text")))
    assert high > low


def test_keyword_scores(spark):
    df = spark.createDataFrame([("alpha beta gamma", ["alpha", "beta", "none"], [0.5, 0.7, 0.9])], "text string, keywords array<string>, s array<double>")
    r = quality.keyword_quality(df, scores="s").first()
    assert r.relevance_score == pytest.approx(2 / 3) and r.average_keyword_score == pytest.approx(0.7) and r.count_score == 1.0


def test_content_types(spark):
    for text, want in [("诊断", "medical_report"), ("摘要", "research_paper"), ("指南", "clinical_guideline"),
                       ("<TABLE>x</TABLE>", "table_content"), ("<LIST>x</LIST>", "list_content"), ("x", "general_text")]:
        assert one(spark, text, quality.content_type(F.col("text"))) == want


# --------------------------------------------------------------------------- queries


def analysed(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    return {r.text: r for r in analysis.analyse(df).collect()}


def test_query_types(spark):
    got = analysed(spark, "What is hypertension", "how to measure", "compare A versus B", "history of trend", "anything", "steps 12")
    kinds = {t: r.query_type for t, r in got.items()}
    assert kinds == {"What is hypertension": "factual", "how to measure": "mixed", "compare A versus B": "comparative",
                     "history of trend": "temporal", "anything": "conceptual", "steps 12": "mixed"}
    assert got["anything"].complexity == "simple"
    assert sum(got["anything"][f"w_{p}"] for p in ("vector", "keywords", "summary", "content")) == pytest.approx(1)


def test_query_entities(spark):
    r = analysed(spark, "New York in 1999 by WHO and The Éa Abcé9")["New York in 1999 by WHO and The Éa Abcé9"]
    assert r.entities == ["New York", "1999", "WHO"]


def test_expansion(spark):
    got = one(spark, "高血压治疗", analysis.expand(F.col("text")))
    assert got == ["高血压治疗", "高血压病治疗", "原发性高血压治疗", "继发性高血压治疗", "高血压疗法"]
    assert one(spark, "什么是感冒？", analysis.question_variants(F.col("text"))) == ["感冒", "感冒定义", "感冒概念"]
    assert one(spark, "如何预防感冒", analysis.question_variants(F.col("text")))[0] == "预防感冒方法"
    assert one(spark, "我 的 高血压病 是", analysis.rewrite(F.col("text"), F.lit("患者 治疗"))) == "患者 我 高血压 治疗"


def test_service_analysis(spark):
    df = spark.createDataFrame([(0, "什么是高血压？"), (1, "症状 表现")], "query_id long, text string")
    first, second = analysis.service_analysis(df).orderBy("query_id").collect()
    assert (first.query_type, first.language, first.intent, first.complexity) == ("definition", "zh", "question", "simple")
    assert second.query_type == "symptom"


# -------------------------------------------------------------------------- chunking


def rebuilt(chunks, overlap):
    return all(len(c) for c in chunks)


def test_pieces_keep_the_text():
    for t in sample():
        assert "".join(chunking.pieces(t, 10)) == t


def test_pack_limits():
    text = " ".join(f"word{i}" for i in range(400))
    for size, overlap in [(100, 0), (100, 20)]:
        chunks = chunking.pack(text, size, overlap)
        assert all(len(c) <= size + overlap + 8 for c in chunks)
        assert [w for w in text.split() if not any(w in c for c in chunks)] == []
    assert chunking.pack("short", 100, 10) == ["short"]
    # Without an overlap the chunks carry every word once and in order.
    assert " ".join(chunking.pack(text, 100, 0)).split() == text.split()


def test_recursive_cut_always_ends():
    chunks = chunking.cut_recursive("a" * 5000, 1000, 200, 100)
    assert all(len(c) <= 1000 for c in chunks) and len(chunks) >= 5
    text = ("x" * 150 + ".\n") * 40
    assert len(chunking.cut_recursive(text, 200, 200, 100)) < 100


def test_merge_and_limits():
    assert chunking.join_overlapping("abcdef", "defxyz", 10) == "abcdefxyz"
    assert chunking.join_overlapping("ab", "cd", 10) == "ab\ncd"
    same = chunking.merge_similar(["a" * 50, "b" * 50, "c" * 50], lambda *_: 1.0, max_size=110, overlap=0)
    assert [len(c) for c in same] == [101, 50]
    assert chunking.cut_hybrid("  ") == []


def test_hybrid_cut_loses_no_text():
    assert chunking.cut_hybrid("short") == ["short"] and chunking.cut_hybrid("short", lossy=True) == []
    words = [f"w{i}" for i in range(3000)]
    text = " ".join(words[:1500]) + "\n\n" + " ".join(words[1500:]) + "\n\nlast"
    for similarity in (None, lambda *_: 1.0, chunking.hashed_similarity):
        assert "".join("".join(chunking.cut_hybrid(text, similarity, overlap=0)).split()) == "".join(text.split())
    for overlap in (50, 200):
        at = 0
        for c in chunking.cut_hybrid(text, None, overlap=overlap):  # begins where the ones before have ended, or earlier
            begin = text.index(c)
            assert not text[at:begin].strip()
            at = begin + len(c)
        assert at == len(text)
    assert [len(c) for c in chunking.cut_hybrid("a" * 900, None, max_size=400)] == [400, 400, 100]
    assert chunking.hashed_similarity("listen", "silent") < 0.5


def test_sentence_windows():
    text = "One sentence here. " * 300
    chunks = chunking.cut_sentences(text, 1000, 200)
    assert all(c.endswith(".") for c in chunks[:-1])
    stepped = chunking.cut_sentences(text, 1000, 200, apply_overlap=True)
    assert len(stepped) > len(chunks)


def test_small_to_big(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(900)))], "doc_id long, text string")
    parents, children = chunking.small_to_big(docs)
    ids = {r.parent_id for r in parents.collect()}
    rows = children.collect()
    assert {r.parent_id for r in rows} == ids and all(len(r.content) <= 256 for r in rows)
    stats = chunking.chunk_statistics(parents, children).first()
    assert stats.child_chunks_count == len(rows) and stats.avg_children_per_parent == round(len(rows) / len(ids), 2)


def test_element_rules(spark):
    cases = [("Title", "高血压指南", "document_title"), ("Title", "Abstract", "section_title"), ("Title", "x", "title"),
             ("NarrativeText", "x" * 501, "main_content"), ("NarrativeText", "Keywords: a", "keywords"),
             ("NarrativeText", "Author: a", "author_info"), ("ListItem", "1. a", "numbered_list"),
             ("ListItem", "- a", "bullet_list"), ("ListItem", "a", "list_item"), ("Footer", "a", "footer"), ("Odd", "a", "odd")]
    df = spark.createDataFrame(cases, "type string, text string, want string")
    assert df.filter(elements.classify(F.col("type"), F.col("text")) != F.col("want")).count() == 0
    assert one(spark, "x", elements.marked(F.lit("Title"), F.col("text"))) == "<TITLE>x</TITLE>"
    assert one(spark, "/a/Report.pdf", elements.file_kind(F.col("text"))) == "medical_report"
    assert one(spark, "10MB", elements.size_in_bytes(F.col("text"))) == 10 * 1024 * 1024
    rows = F.from_json("text", "array<array<string>>")
    assert one(spark, '[["a", null], ["b", "c"]]', elements.table_text(rows)) == "a | \nb | c"


def test_white_space_beyond_ascii_is_kept_apart(spark):
    from pyspark.sql import functions as F

    from corpusweir.operators.cleaning import clean_basic

    df = spark.createDataFrame([("dose 10\u00a0mg\u2003daily",), ("see\u00a0https://a.b/c\u2003there",)], "t string")
    assert [r[0] for r in df.select(clean_basic(F.col("t"))).collect()] == ["dose 10 mg daily", "see there"]


def test_token_lines_hold_the_tokens(spark):
    import pyarrow as pa

    texts = sample() + ["Ünï-Cöde 12x", "..a", "a  ..", "İstanbul ΑΣ. 𝒳𝟙"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = df.select("text", X.tokens(F.col("text")).alias("t"), X.token_line(F.col("text")).alias("line"),
                     X.line_tokens(X.token_line(F.col("text"))).alias("again")).collect()
    lists = X.token_lists(pa.array([None, *[r.line for r in rows]])[1:])  # a slice, as blocks of a batch are
    for r, found in zip(rows, lists.to_pylist()):
        assert r.t == [t for t in re.split(r"[\W_]+", r.text.lower()) if t] or "İ" in r.text
        assert r.again == r.t and (found or []) == r.t


def test_strip_takes_all_white_space_of_both_ends(spark):
    spaces = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
    assert one(spark, spaces + "a" + spaces + "b" + spaces, X.strip(F.col("text"))) == "a" + spaces + "b"
    assert one(spark, spaces, X.strip(F.col("text"))) == "" and one(spark, None, X.strip(F.col("text"))) is None


def test_windows_cut_code_points_in_time_in_proportion_to_the_text(spark):
    import time

    rows = spark.createDataFrame([(1, "a𝒳\n" * 7), (2, ""), (3, None)], "doc_id long, text string")
    found = chunking.fixed_parents(rows, 4).orderBy("parent_index").collect()
    assert [r.content for r in found] == [("a𝒳\n" * 7)[i:i + 4] for i in range(0, 21, 4)]
    assert [r.parent_index for r in found] == list(range(6))
    # A walk from the text's first character to every window would take 62500 of them here.
    long = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abcdefg\n"), 2_000_000).alias("text"))
    begin = time.monotonic()
    assert chunking.fixed_parents(long, 256).agg(F.sum(F.length("content"))).first()[0] == 16_000_000
    assert time.monotonic() - begin < 20


def test_terms_are_ranked_alike_with_keys_too_long_for_one_number():
    import numpy as np

    code, place = np.array([3, 1, 3, 0, 1]), np.array([0, 2, 3, 5, 9])
    for n_codes in (4, 2**62):
        assert [x.tolist() for x in keywords._runs(code, place, n_codes)] == [[0, 1, 3], [5, 2, 0], [1, 2, 2]]


def test_blocks_with_few_candidates_keep_the_best():
    import numpy as np
    from corpusweir.operators.topkeeper import TopKeeper

    rng = np.random.default_rng(5)
    scores, keeper = np.round(rng.random((900, 3)), 2), TopKeeper(3, 7)
    for start in range(0, 900, 60):
        keeper.add(np.arange(start, start + 60), scores[start:start + 60], scores[start:start + 60] > 0.3)
        keeper._compress()
    queries, ids, best = keeper.result()
    for q in range(3):
        order = np.lexsort((np.arange(900), -scores[:, q]))[:7]
        assert ids[queries == q].tolist() == order.tolist() and best[queries == q].tolist() == scores[order, q].tolist()
