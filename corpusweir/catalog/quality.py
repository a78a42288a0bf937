"""Text quality, cleaning, summaries and keywords over whole documents.

The lexicons are Chinese and the given texts are not, so the relevance part is
fed words that occur in them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusweir import lexicon as L
from corpusweir.catalog import clinical as K
from corpusweir.catalog import sql as S
from corpusweir.catalog.registry import query, table, texts
from corpusweir.functions.text import WS, entropy, language, repetition_ratio, snippet, words
from corpusweir.operators import cleaning, ordering, quality, terminology
from corpusweir.operators.keywords import frequent_terms

TERMS = ("the", "of", "and", "der", "la", "que")
GROUPS = {"a": ("the", "of", "and"), "b": ("der", "la", "the")}


def documents(spark, sf):
    return texts(spark, sf).select("doc_id", "text")


def r6(name):
    return F.round(F.col(name), 6).alias(name)


_ENT = """ch AS (SELECT doc_id, c, count(*) AS k FROM (SELECT doc_id, unnest(string_split(lower(text), '')) AS c FROM documents)
   GROUP BY ALL),
 en AS (SELECT doc_id, -sum(k / length(text)::DOUBLE * log2(k / length(text)::DOUBLE)) AS entropy
   FROM ch JOIN documents USING (doc_id) GROUP BY doc_id)"""


@query("text_entropy", "WITH " + _ENT + " SELECT doc_id, round(entropy, 6) AS entropy FROM en")
def text_entropy(spark, sf):
    return documents(spark, sf).select("doc_id", F.round(entropy(F.col("text")), 6).alias("entropy"))


@query("text_repetition", f"""SELECT doc_id, round(CASE WHEN len(w) < 2 THEN 0 ELSE
  (len(w) - len(list_distinct(w))) / len(w)::DOUBLE END, 6) AS repetition
 FROM (SELECT doc_id, {S.words('text')} AS w FROM documents)""")
def text_repetition(spark, sf):
    return documents(spark, sf).select("doc_id", F.round(repetition_ratio(F.col("text")), 6).alias("repetition"))


def _n(pattern, col="text"):
    return f"len(regexp_extract_all({col}, '{pattern}'))"


def _mean_len(sep_regex):
    return f"list_avg(list_transform(string_split_regex(text, '{sep_regex}'), lambda s: length({S.strip('s')})))"


_SCORES = "WITH " + _ENT + f""",
 m AS (SELECT doc_id, text, length(text) AS length, {S.words('text')} AS w, entropy,
   ({_n('the|of|and', 'lower(text)')} + {_n('der|la|the', 'lower(text)')})::DOUBLE AS hits,
   {_n('[^\\p{L}\\p{N}_\\x{09}-\\x{0D}\\x{1C}-\\x{20}\\x{85}\\x{A0}]')} / length(text)::DOUBLE AS punct,
   {_n(WS)} / length(text)::DOUBLE AS blank, {_n('[\\x{4e00}-\\x{9fff}]')} AS cjk, {_n('[a-zA-Z]')} AS latin,
   len(string_split_regex(text, '[.!?。！？]')) AS ns, {_mean_len('[.!?。！？]')} AS ms,
   len(string_split(text, chr(10) || chr(10))) AS np,
   list_avg(list_transform(string_split(text, chr(10) || chr(10)), lambda s: length({S.strip('s')}))) AS mp,
   {_n(chr(92) + 'n')} AS nl FROM documents JOIN en USING (doc_id)),
 r AS (SELECT *, len(w) AS wc, CASE WHEN len(w) < 2 THEN 0 ELSE (len(w) - len(list_distinct(w))) / len(w)::DOUBLE END AS rep,
   CASE WHEN len(w) = 0 THEN 0 ELSE least(1, hits / len(w) * 10) END AS rel FROM m),
 s AS (SELECT *,
   CASE WHEN length < 50 THEN 0 WHEN length > 8000 THEN greatest(0, 1 - (length - 8000) / 8000.0) WHEN length < 200 THEN length / 200.0
     WHEN length <= 2000 THEN 1 ELSE greatest(0.5, 1 - (length - 2000) / 6000.0) END::DOUBLE AS length_score,
   CASE WHEN wc < 10 THEN 0 WHEN wc < 50 THEN wc / 50.0 WHEN wc <= 500 THEN 1
     ELSE greatest(0.5, 1 - (wc - 500) / 1000.0) END::DOUBLE AS word_count_score,
   CASE WHEN rep > 0.7 THEN 0 ELSE 1 - rep / 0.7 END::DOUBLE AS repetition_score,
   CASE WHEN entropy < 2 THEN 0 WHEN entropy < 4 THEN entropy / 4 ELSE 1 END::DOUBLE AS entropy_score,
   CASE WHEN rel < 0.1 THEN 0 ELSE least(1, rel / 0.5) END::DOUBLE AS relevance_score,
   greatest(0, 1 - CASE WHEN punct > 0.3 THEN 0.3 ELSE 0 END - CASE WHEN blank > 0.5 THEN 0.2 ELSE 0 END
     - CASE WHEN cjk + latin > 0 AND cjk / (cjk + latin)::DOUBLE > 0.1 AND cjk / (cjk + latin)::DOUBLE < 0.9 THEN 0.1 ELSE 0 END)::DOUBLE AS language_score,
   greatest(0, 1 - CASE WHEN ns > 1 AND (ms < 10 OR ms > 200) THEN 0.2 ELSE 0 END
     - CASE WHEN np > 1 AND mp < 50 THEN 0.1 ELSE 0 END - CASE WHEN nl > length / 50.0 THEN 0.2 ELSE 0 END)::DOUBLE AS structure_score FROM r),
 o AS (SELECT *, (length_score + word_count_score + repetition_score + entropy_score + relevance_score + language_score
   + structure_score) / 7 AS overall_score FROM s)"""


@query("quality_scores", _SCORES + """
 SELECT doc_id, round(length_score, 6) AS length_score, round(word_count_score, 6) AS word_count_score,
  round(repetition_score, 6) AS repetition_score, round(entropy_score, 6) AS entropy_score,
  round(relevance_score, 6) AS relevance_score, round(language_score, 6) AS language_score,
  round(structure_score, 6) AS structure_score, round(overall_score, 6) AS overall_score FROM o""")
def quality_scores(spark, sf):
    out = quality.assess(documents(spark, sf), groups=GROUPS)
    return out.select("doc_id", *[r6(s) for s in quality.SCORES], r6("overall_score"))


@query("quality_gate", _SCORES + """
 SELECT doc_id, round(overall_score, 6) AS overall_score FROM o WHERE length BETWEEN 50 AND 8000 AND wc >= 10 AND rep <= 0.7
  AND entropy >= 2 AND rel >= 0.1 AND overall_score >= 0.5""")
def quality_gate(spark, sf):
    return quality.filter_chunks(documents(spark, sf), groups=GROUPS).select("doc_id", r6("overall_score"))


@query("quality_by_label", _SCORES + """
 SELECT quality, count(*) AS n, round(avg(overall_score), 6) AS mean_overall FROM o JOIN labels USING (doc_id) GROUP BY quality""")
def quality_by_label(spark, sf):
    scored = quality.assess(documents(spark, sf), groups=GROUPS).select("doc_id", "overall_score")
    joined = scored.join(table(spark, sf, "labels"), "doc_id")
    return joined.groupBy("quality").agg(F.count("*").alias("n"), F.round(F.avg("overall_score"), 6).alias("mean_overall"))


_SHARE = f"len(regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]')) / length({S.strip('text')})::DOUBLE"


@query("document_language", f"""WITH {K.TEXTS} SELECT doc_id, CASE WHEN length({S.strip('text')}) = 0 THEN 'unknown'
 WHEN {_SHARE} > 0.7 THEN 'zh' WHEN {_SHARE} < 0.1 THEN 'en' ELSE 'mixed' END AS detected FROM t0""")
def document_language(spark, sf):
    return K.clinical(spark, sf).select("doc_id", language(F.col("text")).alias("detected"))


@query("content_analysis", f"""SELECT doc_id, length(text) AS char_count, len({S.words('text')}) AS word_count,
 len(string_split_regex(text, '[.!?。！？]')) AS sentence_count, len(string_split(text, chr(10) || chr(10))) AS paragraph_count,
 round({_n('[a-zA-Z]')} / greatest({_n('[a-zA-Z]')}, 1)::DOUBLE, 6) AS english_ratio, 'general_text' AS content_type,
 {_n('<TABLE>.*?</TABLE>')} AS table_count FROM documents""")
def content_analysis(spark, sf):
    cols = quality.content_analysis(F.col("text"))
    keep = ("char_count", "word_count", "sentence_count", "paragraph_count", "english_ratio", "content_type", "table_count")
    out = documents(spark, sf).select("doc_id", *[cols[k].alias(k) for k in keep])
    return out.withColumn("english_ratio", F.round("english_ratio", 6))


# ------------------------------------------------------------- summaries and keywords


def _isin(terms):
    return "(" + ", ".join(f"'{t}'" for t in terms) + ")"


def _read(col):
    return f"""(SELECT CASE WHEN len(sn) = 0 THEN 0 ELSE least(0.6 * CASE WHEN a < 15 THEN a / 15 WHEN a <= 30 THEN 1
   ELSE greatest(0.3, 30 / a) END + 0.4 * CASE WHEN len(sn) < 2 THEN len(sn) / 2.0 WHEN len(sn) <= 8 THEN 1
   ELSE greatest(0.3, 8.0 / len(sn)) END, 1) END FROM (SELECT sn, list_avg(list_transform(sn, lambda s: length(s)))::DOUBLE AS a FROM
   (SELECT list_filter(list_transform(string_split_regex({col}, '[。！？；]'), lambda s: {S.strip('s')}), lambda s: s <> '') AS sn)))::DOUBLE"""


def _fit(n, lo, hi):
    return f"CASE WHEN {n} < {lo} THEN {n} / {lo}.0 WHEN {n} <= {hi} THEN 1 ELSE greatest(0.3, {hi}.0 / {n}) END::DOUBLE"


_SUMQ = f"""WITH d AS (SELECT doc_id, text, {S.snippet('text', 200)} AS summary FROM documents WHERE text <> ''),
 k AS (SELECT *, {S.tok('summary')} AS sw, {S.tok('text')} AS tw, {_read('summary')} AS rd FROM d),
 v AS (SELECT *, list_distinct(sw) AS su, list_distinct(tw) AS tu, list_filter(sw, lambda x: length(x) > 1) AS sc FROM k),
 q AS (SELECT *, {_fit('length(summary)', 20, 500)} AS ls,
   len(list_intersect(su, tu)) / greatest(len(su) + len(tu) - len(list_intersect(su, tu)), 1)::DOUBLE AS cov,
   CASE WHEN len(sc) = 0 THEN 0 ELSE least(len(list_filter(sc, lambda x: x IN {_isin(TERMS)})) / len(sc)::DOUBLE * 3, 1) END AS mr,
   CASE WHEN len(sc) = 0 THEN 0 ELSE least(0.7 * len(list_distinct(sc)) / len(sc)::DOUBLE
     + 0.3 * len(list_filter(sc, lambda x: x IN {_isin(TERMS)})) / len(sc)::DOUBLE, 1) END AS den,
   length(summary) / length(text)::DOUBLE AS cr FROM v),
 f AS (SELECT *, least(ls * 0.15 + rd * 0.20 + cov * 0.25 + rd * 0.15 + mr * 0.15 + den * 0.10
   + CASE WHEN mr > 0.3 THEN 0.1 ELSE 0 END, 1) AS overall FROM q)"""


@query("summary_quality", _SUMQ + """
 SELECT doc_id, round(cov, 6) AS coverage_score, round(rd, 6) AS readability_score, round(mr, 6) AS medical_relevance_score,
  round(cr, 6) AS compression_ratio, round(den, 6) AS info_density, round(overall, 6) AS overall_score,
  CASE WHEN overall >= 0.8 THEN 'excellent' WHEN overall >= 0.6 THEN 'good' WHEN overall >= 0.4 THEN 'fair' ELSE 'poor' END
   AS quality_level FROM f""")
def summary_quality(spark, sf):
    docs = documents(spark, sf).filter("text <> ''").withColumn("summary", snippet(F.col("text"), 200))
    out = quality.summary_quality(docs, terms=TERMS)
    return out.select("doc_id", r6("coverage_score"), r6("readability_score"), r6("medical_relevance_score"),
                      r6("compression_ratio"), r6("info_density"), r6("overall_score"), "quality_level")


@query("keyword_quality", f"""WITH w AS (SELECT doc_id, unnest({S.words('text')}) AS word, generate_subscripts({S.words('text')}, 1) AS pos FROM documents),
 c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS pos FROM w GROUP BY ALL),
 t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS rank FROM c QUALIFY rank <= 10),
 d AS (SELECT doc_id, text, k, {S.tok('text')} AS tw FROM documents JOIN (SELECT doc_id, list(word ORDER BY rank) AS k FROM t GROUP BY doc_id) USING (doc_id)),
 v AS (SELECT *, list_distinct({S.tok("array_to_string(k, ' ')")}) AS ku, list_distinct(tw) AS tu, len(k)::DOUBLE AS n,
   list_transform(k, lambda x: length(x)::DOUBLE) AS ln FROM d WHERE len(k) > 0 AND text <> ''),
 q AS (SELECT *, {_fit('n', 3, 15)} AS cs, len(list_filter(k, lambda x: list_contains(tw, lower(x)))) / n AS rs,
   0.7 * len(list_distinct(k)) / n + 0.3 * least((list_sum(list_transform(ln, lambda x: (x - list_avg(ln)) * (x - list_avg(ln)))) / n) / 10, 1) AS ds,
   len(list_intersect(ku, tu)) / greatest(len(ku) + len(tu) - len(list_intersect(ku, tu)), 1)::DOUBLE AS cov,
   len(list_filter(k, lambda x: x IN {_isin(TERMS)})) / n AS sp FROM v),
 f AS (SELECT *, least(cs * 0.15 + rs * 0.25 + ds * 0.20 + cov * 0.20 + sp * 0.10 + 0.10 + CASE WHEN sp > 0.3 THEN 0.1 ELSE 0 END, 1) AS o FROM q)
 SELECT doc_id, round(rs, 6) AS relevance_score, round(ds, 6) AS diversity_score, round(cov, 6) AS coverage_score,
  round(sp, 6) AS medical_specificity_score, round(o, 6) AS overall_score, CASE WHEN o >= 0.8 THEN 'excellent'
  WHEN o >= 0.6 THEN 'good' WHEN o >= 0.4 THEN 'fair' ELSE 'poor' END AS quality_level FROM f""")
def keyword_quality(spark, sf):
    docs = documents(spark, sf).filter("text <> ''")
    best = frequent_terms(docs.select("doc_id", words(F.col("text")).alias("terms")), ["doc_id"], 10)
    lists = best.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda k: k["term"]).alias("keywords"))
    docs = docs.join(lists, "doc_id")
    out = quality.keyword_quality(docs, terms=TERMS)
    return out.select("doc_id", r6("relevance_score"), r6("diversity_score"), r6("coverage_score"),
                      r6("medical_specificity_score"), r6("overall_score"), "quality_level")


@query("summary_levels", _SUMQ + """
 SELECT CASE WHEN overall >= 0.8 THEN 'excellent' WHEN overall >= 0.6 THEN 'good' WHEN overall >= 0.4 THEN 'fair' ELSE 'poor' END
  AS quality_level, count(*) AS n FROM f GROUP BY 1""")
def summary_levels(spark, sf):
    docs = documents(spark, sf).filter("text <> ''").withColumn("summary", snippet(F.col("text"), 200))
    return quality.summary_quality(docs, terms=TERMS).groupBy("quality_level").agg(F.count("*").alias("n"))


@query("optional_score_mean", """SELECT doc_id, round(coalesce((coalesce(rouge_l * 0.3, 0) + coalesce(sim * 0.25, 0) + coalesce(coh * 0.25, 0))
  / nullif(CASE WHEN rouge_l IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN sim IS NOT NULL THEN 0.25 ELSE 0 END
  + CASE WHEN coh IS NOT NULL THEN 0.25 ELSE 0 END, 0), 0), 6) AS overall FROM
 (SELECT doc_id, CASE WHEN quality = 1 THEN least(n_chars / 5000.0::DOUBLE, 1) END AS rouge_l, toxic::DOUBLE AS sim,
  CASE WHEN lang = 'en' THEN 0.5 END AS coh FROM documents LEFT JOIN labels USING (doc_id))""")
def optional_score_mean(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id", F.when(F.col("quality") == 1, F.least(F.col("n_chars") / 5000.0, F.lit(1.0))).alias("rouge_l"),
        F.col("toxic").cast("double").alias("semantic_similarity"),
        F.when(F.col("lang") == "en", 0.5).alias("coherence_score"), F.lit(None).cast("double").alias("coverage_score"))
    return docs.select("doc_id", F.round(quality.present_mean(quality.SUMMARY_SHARES), 6).alias("overall"))


# --------------------------------------------------------------------------- cleaning


_KEYED = r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
   generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
 s AS (SELECT doc_id, i, {strip} AS line FROM l),
 k AS (SELECT *, regexp_replace(lower(line), '[^\p{{L}}\p{{N}}_]', '', 'g') AS key FROM s WHERE line <> ''),
 f AS (SELECT * FROM k WHERE length(key) >= 10 QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY i) = 1)""".format(
    strip=S.strip("raw"))


@query("redundant_lines", _KEYED + """
 SELECT d.doc_id, md5(coalesce(string_agg(line, chr(10) ORDER BY i), '')) AS text_md5, count(line) AS n_lines
 FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id""")
def redundant_lines(spark, sf):
    out = documents(spark, sf).withColumn("kept", cleaning.drop_repeated_lines(F.col("text")))
    n = F.when(F.col("kept") == "", 0).otherwise(F.size(F.split("kept", "\n")))
    return out.select("doc_id", F.md5("kept").alias("text_md5"), n.cast("long").alias("n_lines"))


@query("drop_headers", f"WITH {K.TEXTS}, {K.without_headers('h', 't0')} SELECT doc_id, md5(text) AS text_md5 FROM h")
def drop_headers(spark, sf):
    return K.clinical(spark, sf).select("doc_id", F.md5(cleaning.drop_headers(F.col("text"))).alias("text_md5"))


_ABBREVIATED = [e for e in L.CLEANER_ABBREVIATIONS.items() if e[0] != e[1]]


@query("clean_text", f"""WITH {K.TEXTS}, {K.without_noise('n', 't0')}, {K.without_headers('h', 'n')}, {K.replaced('e', 'h', _ABBREVIATED)},
 {K.without_repeats('r', 'e')}, {K.without_noise('m', 'r')}
 SELECT doc_id, CASE WHEN {S.strip('r.text')} = '' THEN '' ELSE {K.collapsed('m.text')} END AS cleaned FROM m JOIN r USING (doc_id)""")
def clean_text(spark, sf):
    return cleaning.clean_steps(K.clinical(spark, sf)).select("doc_id", "cleaned")


@query("clean_basic", rf"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
   '[^\p{{L}}\p{{N}}_\s\x{{0b}}\x{{3000}}-\x{{303f}}\x{{ff00}}-\x{{ffef}}.,;:!?()\[\]{{}}"—–\-+*/=<>@#$%^&|\\~`]+', '', 'g'),
   '\n\s*\n\s*\n+', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), '^{S.WS}+|{S.WS}+$', '', 'g') AS t FROM documents),
 b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
   regexp_replace(t, '([.,:;!?])[.,:;!?]+', '\1', 'g'), '^\s*[0-9]+\s*$', '', 'g'), '^\s*Page\s+\d+\s*$', '', 'g'), '^\s*-\s*\d+\s*-\s*$', '', 'g'),
   '(DOI|ISSN|doi)[:：]\s*[^\n]+', '', 'g'),
   '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}\b', '', 'g') AS t FROM a),
 c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, 'https?://[^\s]+', '', 'g'), 'www\.[^\s]+', '', 'g'),
   '[·•\-=]{{3,}}', '', 'g'), '[*]{{3,}}', '', 'g') AS t FROM b)
 SELECT doc_id, md5({S.strip("regexp_replace(t, '" + S.WS + "+', ' ', 'g')")}) AS text_md5 FROM c""")
def clean_basic(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(cleaning.clean_basic(F.col("text"))).alias("text_md5"))


@query("text_structure", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
   generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
 s AS (SELECT doc_id, i, {strip} AS x FROM l),
 k AS (SELECT *, CASE WHEN x = '' THEN 'blank'
   WHEN length(x) < 100 AND ((x = upper(x) AND lower(x) <> upper(x)) OR regexp_matches(x, '^\p{{Nd}}+[\.、]\s*[^0-9]')) THEN 'titles'
   WHEN regexp_matches(x, '^[•·\-\*]\s+|^\p{{Nd}}+[\.）\)]\s+|^[（\(]\p{{Nd}}+[）\)]\s+') THEN 'lists'
   WHEN regexp_matches(x, '^\[\p{{Nd}}+\]|^\p{{Nd}}+\.\s+[A-Z]') THEN 'references' ELSE 'paragraphs' END AS kind FROM s),
 g AS (SELECT *, kind = 'paragraphs' AND coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY i), '') <> 'paragraphs' AS starts FROM k)
 SELECT doc_id, count(*) FILTER (kind = 'titles') AS titles, count(*) FILTER (kind = 'lists') AS lists,
  count(*) FILTER (kind = 'references') AS refs, count(*) FILTER (starts) AS paragraphs FROM g GROUP BY doc_id""".format(strip=S.strip("raw")))
def text_structure(spark, sf):
    out = documents(spark, sf).withColumn("m", cleaning.structure(F.col("text")))
    return out.select("doc_id", *[
        F.size(F.col("m")[k]).cast("long").alias("refs" if k == "references" else k)
        for k in ("titles", "lists", "references", "paragraphs")])


_NOT, _NOT_CJK = "|".join(cleaning.NOT_A_TITLE), "|".join(cleaning.NOT_A_CJK_TITLE)


@query("document_titles", f"""WITH {K.TEXTS},
 l AS (SELECT doc_id, unnest(string_split(text, chr(10))[1:20]) AS raw, generate_subscripts(string_split(text, chr(10))[1:20], 1) AS i FROM t0),
 s AS (SELECT doc_id, i, {S.strip('raw')} AS x FROM l),
 c AS (SELECT doc_id, 0 AS k, i, x, length(x) AS w FROM s WHERE length(x) BETWEEN 10 AND 100 AND (length(x) >= 20 OR NOT contains(x, '·'))
   AND NOT regexp_matches(x, {K.literal('(?i)' + _NOT)})
  UNION ALL SELECT doc_id, 1, i, x, length(x) + CASE WHEN contains(x, '中国扩张型心肌病诊断和治疗指南') THEN 200
   WHEN regexp_matches(x, '指南|规范|标准|诊断|治疗') THEN 100 ELSE 0 END + CASE WHEN length(x) >= 15 AND NOT regexp_matches(x, '[，。；：]') THEN 30 ELSE 0 END
  FROM s WHERE i <= 15 AND length(x) BETWEEN 8 AND 80 AND regexp_matches(x, '[\\x{{4e00}}-\\x{{9fff}}]') AND NOT regexp_matches(x, {K.literal(_NOT_CJK)})),
 b AS (SELECT doc_id, regexp_replace(regexp_replace(x, '^[·•\\-\\s]+|[·•\\-\\s]+$', '', 'g'), '{WS}+', ' ', 'g') AS tidy FROM c
   QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, k, i) = 1)
 SELECT doc_id, CASE WHEN length(tidy) >= 10 THEN tidy ELSE concat_ws('-', source, doc_id) END AS title FROM t0 LEFT JOIN b USING (doc_id)""")
def document_titles(spark, sf):
    docs = K.clinical(spark, sf)
    return docs.select("doc_id", cleaning.title(F.col("text"), F.concat_ws("-", "source", "doc_id")).alias("title"))


@query("document_references", rf"""WITH {K.TEXTS},
 s AS (SELECT doc_id, coalesce(nullif(regexp_extract(text, '(?is)(references|bibliography|参考文献).*'), ''),
   regexp_extract(text, '(?is)(参考资料|引用文献|文献引用).*')) AS part FROM t0),
 m AS (SELECT doc_id, CASE WHEN regexp_matches(part, '\[\d+\]') THEN '\[\d+\]' ELSE '\d+\.\s+' END AS mark, part FROM s WHERE part <> ''),
 e AS (SELECT doc_id, {S.strip('e')} AS e FROM (SELECT doc_id, unnest(string_split(regexp_replace(part, mark, chr(57344) || '\0', 'g'), chr(57344))[2:]) AS e FROM m))
 SELECT doc_id, regexp_extract(e, '[\[\(]?(\d+)[\]\)]?', 1) AS reference_id, e AS reference_text FROM e WHERE length(e) > 10""")
def document_references(spark, sf):
    docs = K.clinical(spark, sf).select("doc_id", F.explode(cleaning.references(F.col("text"))).alias("r"))
    return docs.select("doc_id", "r.reference_id", "r.reference_text")


@query("standardise_terms", f"""WITH {K.TEXTS}, {K.replaced('e', 't0', K.standard_entries())}
 SELECT doc_id, md5(CASE WHEN trim(t0.text) = '' THEN '' ELSE e.text END) AS text_md5, e.text <> t0.text AS changed FROM e JOIN t0 USING (doc_id)""")
def standardise_terms(spark, sf):
    out = K.clinical(spark, sf).withColumn("s", terminology.standardiser()(F.col("text")))
    return out.select("doc_id", F.md5("s").alias("text_md5"), (F.col("s") != F.col("text")).alias("changed"))


@query("expand_abbreviations", f"""WITH {K.TEXTS}, {K.replaced('e', 't0', _ABBREVIATED)} SELECT doc_id, md5(text) AS text_md5 FROM e""")
def expand_abbreviations(spark, sf):
    return K.clinical(spark, sf).select("doc_id", F.md5(cleaning.expand_abbreviations(F.col("text"))).alias("text_md5"))


def _listed(names) -> str:
    return "[" + ", ".join(K.literal(x) for x in names) + "]"


def _named(names, how: str = "contains(text, x)") -> str:
    return f"array_to_string(list_filter({_listed(names)}, lambda x: {how}), '|')"


# A pattern made per row is dear: only texts that hold the letters are searched.
_ALONE = r"CASE WHEN contains(text, x) THEN regexp_matches(text, '(^|[^\p{L}\p{N}_])' || x || '($|[^\p{L}\p{N}_])') ELSE false END"


@query("term_entities", f"""WITH {K.TEXTS} SELECT doc_id, {_named(L.DISEASES)} AS diseases, {_named(L.DRUGS)} AS drugs, {_named(L.PROCEDURES)} AS procedures,
 {_named(L.ABBREVIATIONS, _ALONE)} AS abbreviations FROM t0""")
def term_entities(spark, sf):
    found = terminology.entity_classes(F.col("text"))
    return K.clinical(spark, sf).select(
        "doc_id", *[F.array_join(found[k], "|").alias(k) for k in ("diseases", "drugs", "procedures", "abbreviations")])


def _pairs(entries) -> str:
    return "[" + ", ".join(f"{{'x': {K.literal(a)}, 'y': {K.literal(b)}}}" for a, b in entries) + "]"


_ODD = [(a, b) for a, b in L.STANDARD_TERMS.items() if b not in a]


@query("terminology_validation", f"""WITH {K.TEXTS},
 v AS (SELECT doc_id, list_filter({_pairs(_ODD)}, lambda p: contains(text, p.x) AND NOT contains(text, p.y)) AS odd,
  list_filter({_pairs(L.ABBREVIATIONS.items())}, lambda p: {_ALONE.replace(' x', ' p.x')} AND NOT contains(text, p.y)) AS short FROM t0)
 SELECT doc_id, array_to_string(list_transform(odd, lambda p: p.x), '|') AS non_standard_terms,
  array_to_string(list_transform(short, lambda p: p.x), '|') AS missing_standardization,
  array_to_string(list_transform(odd, lambda p: 'Replace ' || chr(39) || p.x || chr(39) || ' with ' || chr(39) || p.y || chr(39))
   || list_transform(short, lambda p: 'Consider expanding ' || chr(39) || p.x || chr(39) || ' to ' || chr(39) || p.y || chr(39)), '|') AS suggestions FROM v""")
def terminology_validation(spark, sf):
    found = terminology.validate(F.col("text"))
    return K.clinical(spark, sf).select("doc_id", *[F.array_join(c, "|").alias(k) for k, c in found.items()])
