"""What is built on the ranked rows: weighting, sources, snippets, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusweir.catalog import analysis as A
from corpusweir.catalog import sql as S
from corpusweir.catalog.fixtures import chunk_corpus, chunk_lists, chunk_queries, query_set
from corpusweir.catalog.registry import query, table, texts
from corpusweir.config import PATHS, RetrievalConfig, preset
from corpusweir.operators import analysis, audit, context, metrics, parents, terminology, weights
from corpusweir.plans import answering
from corpusweir.plans import retrieval as plan
from corpusweir.session import checkpointed, is_few
from corpusweir.sources.models import hashed_vectors

_FUSED = "WITH " + S.FUSED


def r6(name):
    return F.round(F.col(name), 6).alias(name)


def best_rows(spark, sf):
    corpus = chunk_corpus(spark, sf)
    best = checkpointed(plan.retrieve(corpus, chunk_queries(spark, sf)))
    return plan.with_text(best, corpus, is_few(best))


@query("search_projection", _FUSED + """
 SELECT query_id, rank, rrk.doc_id, round(fused_rerank_score, 6) AS score,
  CASE WHEN rrk.parent_id IS NOT NULL THEN 'parent_chunk' ELSE 'text' END AS kind, split_part(rrk.doc_id, '-', 1) AS source
 FROM rrk JOIN child ON chunk_id = rrk.doc_id WHERE fused_rerank_score >= 0.5""")
def search_projection(spark, sf):
    rows = best_rows(spark, sf).filter("fused_rerank_score >= 0.5")
    return rows.select(
        "query_id", "rank", "doc_id", F.round("fused_rerank_score", 6).alias("score"),
        F.when(F.col("parent_id").isNotNull(), "parent_chunk").otherwise("text").alias("kind"),
        F.split_part("doc_id", F.lit("-"), F.lit(1)).alias("source"))


@query("distinct_sources", _FUSED + """,
 d AS (SELECT *, split_part(doc_id, '-', 1) AS document_id FROM rrk),
 f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank) = 1)
 SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS source_rank FROM f
 QUALIFY source_rank <= 3""")
def distinct_sources(spark, sf):
    best = plan.retrieve(chunk_corpus(spark, sf), chunk_queries(spark, sf))
    rows = best.withColumn("document_id", F.split_part("doc_id", F.lit("-"), F.lit(1)))
    return context.distinct_sources(rows).select("query_id", "document_id", "source_rank")


@query("reference_snippets", _FUSED + """
 SELECT query_id, rank, md5(substr(content, 1, 200) || '...') AS snippet_md5 FROM rrk JOIN child ON chunk_id = rrk.doc_id
 WHERE rank <= 3""")
def reference_snippets(spark, sf):
    out = context.reference_snippets(best_rows(spark, sf))
    return out.select("query_id", "rank", F.md5("snippet").alias("snippet_md5"))


@query("display_names", """SELECT doc_id, CASE WHEN lang = 'en' THEN source WHEN lang = 'fr' THEN 'title-' || doc_id
  WHEN lang = 'de' THEN 'doc-' || doc_id ELSE '未知文档' END AS name FROM documents""")
def display_names(spark, sf):
    docs = table(spark, sf, "documents")
    ident = F.col("doc_id").cast("string")
    none = F.lit(None).cast("string")

    def only(lang, value):
        return F.when(F.col("lang") == lang, value)

    name = context.display_name(
        {"file_name": F.lit(""), "source": F.coalesce(only("en", F.col("source")), ident),
         "title": only("fr", F.concat(F.lit("title-"), ident)), "original_filename": none, "filename": none},
        ident, none, none, only("de", F.concat(F.lit("/data/doc-"), ident)))
    return docs.select("doc_id", name.alias("name"))


@query("disclaimers", """SELECT conv_id, turn, length(text) + 51 AS n FROM conversations WHERE role = 'assistant'""".replace(
    "51", str(len(context.DISCLAIMER))))
def disclaimers(spark, sf):
    rows = table(spark, sf, "conversations").filter("role = 'assistant'")
    twice = context.with_disclaimer(context.with_disclaimer(F.col("text")))
    return rows.select("conv_id", "turn", F.length(twice).cast("long").alias("n"))


@query("answer_prompts", "SELECT item_id AS query_id, md5('Q: ' || text || chr(10) || 'C: ' || length(text)) AS prompt_md5 FROM benchmark")
def answer_prompts(spark, sf):
    rows = table(spark, sf, "benchmark")
    text = context.prompt("Q: {query}\nC: {context}", F.col("text"), F.length("text").cast("string"))
    return rows.select(F.col("item_id").alias("query_id"), F.md5(text).alias("prompt_md5"))


_VARIANTS = """ qry AS (SELECT item_id || '#' || (i - 1) AS query_id, v AS text FROM (SELECT item_id, unnest(vs) AS v, generate_subscripts(vs, 1) AS i
   FROM (SELECT item_id, CASE WHEN contains(text, '?') THEN [text]
    ELSE [text, '什么是' || text, text || '是什么', '如何' || text, text || '的症状'] END AS vs FROM benchmark)))"""


@query("question_prompts", "WITH " + S.child_lists(_VARIANTS, "each_list") + """,
 nest AS (SELECT split_part(query_id, '#', 1)::BIGINT AS query_id, path, doc_id, any_value(parent_id) AS parent_id,
   round(sum(1.0 / (60 + rank)), 9) AS s, max(score) AS score FROM each_list GROUP BY ALL),
 lists AS (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY s DESC, doc_id) AS rank FROM nest
   QUALIFY rank <= CASE path WHEN 'vector' THEN 50 WHEN 'keywords' THEN 30 ELSE 20 END)""" + S.DEDUP + S.FUSION + """,
 t AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, parent.content,
   split_part(parent_id, '-', 1) AS source, fused_rerank_score AS s FROM rrk JOIN parent USING (parent_id) WHERE rank <= 5),
 c AS (SELECT query_id, string_agg(rank || ' (来源: ' || source || ', 相关度: ' || printf('%.3f', s) || '):' || chr(10)
  || content || chr(10), chr(10) ORDER BY rank) AS context, round(avg(CASE WHEN rank <= 3 THEN s END), 6) AS confidence_score FROM t GROUP BY query_id)
 SELECT item_id AS query_id, md5(coalesce(context, '') || chr(10) || chr(10) || 'Q: ' || text) AS prompt_md5,
  coalesce(confidence_score, 0) AS confidence_score, CASE WHEN contains(text, '?') THEN 1 ELSE 5 END::BIGINT AS n_variants
 FROM benchmark LEFT JOIN c ON query_id = item_id""")
def question_prompts(spark, sf):
    """Every question in its variants, to the prompt that a model gets."""
    out = answering.prompts(chunk_corpus(spark, sf), query_set(spark, sf), lambda rows: hashed_vectors(rows, "text"))
    return out.select("query_id", F.md5("prompt").alias("prompt_md5"), r6("confidence_score"), "n_variants")


_WEIGHTED = A.LOW + ", " + S.CHILD_LISTS + f""",
 fi AS (SELECT query_id, {A.QUERY_AWARE['vector']} AS v, {A.QUERY_AWARE['keywords']} AS k, {A.QUERY_AWARE['summary']} AS s,
   {A.QUERY_AWARE['content']} AS c FROM rt),
 f1 AS (SELECT query_id, greatest(0.05, least(0.7, v / (v + k + s + c))) AS v, greatest(0.05, least(0.7, k / (v + k + s + c))) AS k,
   greatest(0.05, least(0.7, s / (v + k + s + c))) AS s, greatest(0.05, least(0.7, c / (v + k + s + c))) AS c FROM fi),
 wq AS (SELECT query_id, unnest(['vector', 'keywords', 'summary', 'content']) AS path,
   unnest([v / (v + k + s + c), k / (v + k + s + c), s / (v + k + s + c), c / (v + k + s + c)]) AS weight FROM f1),
 fus AS (SELECT d.query_id, doc_id, round(sum(weight / (60 + rank)), 9) AS fusion_score,
   max(CASE WHEN d.path <> 'vector' THEN score END) AS bm, max(CASE WHEN d.path = 'vector' THEN score END) AS sim
   FROM ddp d JOIN wq ON wq.query_id = 'b' || d.query_id AND wq.path = d.path GROUP BY ALL),
 fk AS (SELECT * FROM fus QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, doc_id) <= 10),
 rr AS (SELECT *, round((0.4 * fusion_score + coalesce(0.3 * bm, 0) + coalesce(0.2 * sim, 0)) / (0.4
   + CASE WHEN bm IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN sim IS NOT NULL THEN 0.2 ELSE 0 END), 9) AS f FROM fk)
 SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, doc_id) AS rank, doc_id,
  round(fusion_score, 6) AS fusion_score, round(f, 6) AS fused_rerank_score FROM rr"""


@query("weighted_retrieval", _WEIGHTED)
def weighted_retrieval(spark, sf):
    """Analysis, adapted weights per query, four paths, fusion, re-ranking."""
    queries = chunk_queries(spark, sf)
    adapted = weights.adjust(analysis.query_contexts(analysis.analyse(queries)), RetrievalConfig().weights(), "query_aware")
    out = plan.retrieve(chunk_corpus(spark, sf), queries, weights=analysis.as_rows(adapted, "f_"))
    return out.select("query_id", "rank", "doc_id", r6("fusion_score"), r6("fused_rerank_score"))


@query("preset_comparison", _FUSED + """,
 p AS (SELECT * FROM (VALUES ('balanced', 0.4, 0.3, 0.2, 0.1, 60), ('keyword_focused', {kf}, 60), ('high_precision', 0.4, 0.3, 0.2, 0.1, 30))
   v(preset, vector, keywords, summary, content, k)),
 s AS (SELECT preset, query_id, doc_id, round(sum(CASE path WHEN 'vector' THEN vector WHEN 'keywords' THEN keywords WHEN 'summary' THEN summary
   ELSE content END::DOUBLE / (k + rank)), 9) AS fs FROM ddp, p GROUP BY ALL),
 t AS (SELECT *, row_number() OVER (PARTITION BY preset, query_id ORDER BY fs DESC, doc_id) AS r FROM s QUALIFY r <= 10)
 SELECT preset, count(*) AS n, round(avg(fs), 6) AS mean_score FROM t GROUP BY preset""".replace(
    "{kf}", ", ".join(repr(preset("keyword_focused").weights()[p]) for p in PATHS)))
def preset_comparison(spark, sf):
    """One search, fused under several configurations (the configuration search)."""
    lists = chunk_lists(spark, sf)
    parts = []
    for name in ("balanced", "keyword_focused", "high_precision"):
        fused = plan.fused_candidates(lists, preset(name), top=10)
        parts.append(fused.select(F.lit(name).alias("preset"), "fusion_score"))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("preset").agg(F.count("*").alias("n"), F.round(F.avg("fusion_score"), 6).alias("mean_score"))


_PRESETS = ("balanced", "vector_focused", "keyword_focused", "fast_retrieval", "high_precision")


# Weights and lengths as the presets are documented: the order of their steps decides.
@query("preset_search", "WITH " + S.CHILD_LISTS.replace("ddp AS", "ddp0 AS") + """,
 p AS (SELECT * FROM (VALUES ('balanced', 'vector', 0.4, 50, 60), ('balanced', 'keywords', 0.3, 30, 60), ('balanced', 'summary', 0.2, 20, 60),
   ('balanced', 'content', 0.1, 20, 60), ('high_precision', 'vector', 0.4, 50, 30), ('high_precision', 'keywords', 0.3, 30, 30),
   ('high_precision', 'summary', 0.2, 20, 30), ('high_precision', 'content', 0.1, 20, 30), ('vector_focused', 'vector', 0.590219224283, 50, 60), ('vector_focused', 'keywords', 0.219224283305, 30, 60), ('vector_focused', 'summary', 0.106239460371, 20, 60),
   ('keyword_focused', 'vector', 0.230414746544, 50, 60), ('keyword_focused', 'keywords', 0.460829493088, 30, 60), ('keyword_focused', 'summary', 0.207373271889, 20, 60), ('keyword_focused', 'content', 0.101382488479, 20, 60),
   ('fast_retrieval', 'vector', 0.7, 50, 60), ('fast_retrieval', 'keywords', 0.3, 30, 60)) v(preset, path, w, lim, k)),
 c AS (SELECT preset, w::DOUBLE AS w, k, query_id, path, doc_id, rank, parent_id FROM lists JOIN p USING (path) WHERE rank <= lim
   QUALIFY row_number() OVER (PARTITION BY preset, query_id, path, parent_id ORDER BY rank) = 1),
 d AS (SELECT *, row_number() OVER (PARTITION BY preset, query_id, path ORDER BY rank) AS r FROM c),
 f AS (SELECT preset, query_id, doc_id, round(sum(w / (k + r)), 9) AS fs FROM d GROUP BY ALL)
 SELECT preset, query_id, doc_id, row_number() OVER (PARTITION BY preset, query_id ORDER BY fs DESC, doc_id) AS rank, round(fs, 6) AS fusion_score
 FROM f QUALIFY rank <= 10""")
def preset_search(spark, sf):
    """All presets side by side from one search."""
    configs = {name: preset(name) for name in _PRESETS}
    lists = plan.ranked_lists(chunk_corpus(spark, sf), chunk_queries(spark, sf), plan.widest(configs))
    return plan.fused_under(lists, configs, 10).select("preset", "query_id", "doc_id", "rank", r6("fusion_score"))


@query("configuration_search", """WITH a AS (SELECT event_type AS config, avg(value * 10) FILTER (value <= 60) AS l, avg((value <= 60)::INT) AS s
  FROM events GROUP BY event_type),
 b AS (SELECT config, l, s, coalesce((greatest(0, (600 - l) / 600) * 0.6 + s * 0.4) * 100, 0) AS score FROM a)
 SELECT config, round(l, 6) AS avg_latency, round(s, 6) AS success_rate, round(score, 6) AS score,
  row_number() OVER (ORDER BY score DESC, config) AS rank FROM b""")
def configuration_search(spark, sf):
    """Measured runs of several configurations (an event type stands for one), scored and ranked."""
    runs = table(spark, sf, "events").select(F.col("event_type").alias("config"), (F.col("value") * 10).alias("ms"), (F.col("value") > 60).alias("failed"))
    out = metrics.configuration_scores(runs, "config", "ms", F.col("failed"), 600.0)
    return out.select("config", r6("avg_latency"), r6("success_rate"), r6("score"), "rank")


@query("switch_preserving", _FUSED + """
 SELECT query_id, cnd.doc_id AS original_id, p.parent_id IS NOT NULL AS switched_to_parent, md5(coalesce(p.content, child.content)) AS content_md5
 FROM cnd JOIN child ON chunk_id = cnd.doc_id LEFT JOIN (SELECT * FROM parent WHERE parent_index > 0) p ON p.parent_id = cnd.parent_id""")
def switch_preserving(spark, sf):
    corpus = chunk_corpus(spark, sf)
    fused = checkpointed(plan.fused_candidates(chunk_lists(spark, sf, corpus), RetrievalConfig()))
    few = is_few(fused)
    rows = plan.with_text(fused, corpus, few)
    out = parents.switch_to_parents(rows, corpus.parents.filter("parent_index > 0"), preserve=True, few=few)
    return out.select("query_id", "original_id", "switched_to_parent", F.md5("content").alias("content_md5"))


@query("context_features", """SELECT 'b' || item_id AS query_id, regexp_matches(text, '\\p{Nd}') AS has_numbers FROM benchmark
 UNION ALL SELECT 'c' || conv_id || '-' || turn, regexp_matches(text, '\\p{Nd}') FROM conversations WHERE role = 'user'""")
def context_features(spark, sf):
    return A.contexts(spark, sf).select("query_id", "has_numbers")


# ------------------------------------------------------------------------------ audit

_LINES = """WITH t AS (SELECT page_id AS doc_id, url || chr(10) || html AS text FROM pages),
 l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
   generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM t)"""


def source_lines(spark, sf):
    pages = texts(spark, sf, "pages", "page_id")
    return audit.lines(pages.withColumn("text", F.concat_ws("\n", "url", "html")), "page_id", "text")


@query("audit_hard_coded", _LINES + """,
 n AS (SELECT * FROM l WHERE NOT starts_with(trim(line), '#'))
 SELECT doc_id, line_no, 'http url' AS finding FROM n WHERE regexp_matches(line, 'http://[^"'']+')
 UNION ALL SELECT doc_id, line_no, 'https url' FROM n WHERE regexp_matches(line, 'https://[^"'']+')
 UNION ALL SELECT doc_id, line_no, 'localhost' FROM n WHERE contains(line, 'localhost')
 UNION ALL SELECT doc_id, line_no, 'local ip' FROM n WHERE contains(line, '127.0.0.1')
 UNION ALL SELECT doc_id, line_no, 'api key' FROM n WHERE regexp_matches(line, 'sk-[a-zA-Z0-9]{48}')
 UNION ALL SELECT doc_id, line_no, 'database url' FROM n WHERE regexp_matches(line, 'postgresql://[^"'']+')
 UNION ALL SELECT doc_id, line_no, 'redis url' FROM n WHERE regexp_matches(line, 'redis://[^"'']+')""")
def audit_hard_coded(spark, sf):
    rows = source_lines(spark, sf)
    return audit.hard_coded(rows).select(F.col("path").alias("doc_id"), "line_no", "finding")


@query("audit_report", _LINES + """,
 n AS (SELECT * FROM l WHERE NOT starts_with(trim(line), '#') AND regexp_matches(line, 'https://[^"'']+')),
 r AS (SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS k FROM n)
 SELECT 'https url' AS finding, count(*) AS n, string_agg(doc_id || ':' || line_no, chr(10) ORDER BY k) FILTER (k <= 10) AS examples
 FROM r HAVING count(*) > 0""")
def audit_report(spark, sf):
    rows = source_lines(spark, sf)
    return audit.report(audit.hard_coded(rows, {"https url": audit.HARD_CODED["https url"]}))


# Pages as the lines of programs: frequent words become notes and reads of the environment.
_AS_CODE = """replace(replace(replace(replace(replace(replace(html, ' the ', ' TODO: '), ' of ', ' FIXME: '), ' and ', ' HACK: '), ' de ', ' XXX: '),
 ' to ', ' os.getenv("en") '), ' in ', ' os.getenv(''LANG_DIR'') ')"""
_CODE_LINES = f"""WITH t AS (SELECT page_id AS doc_id, url || chr(10) || {_AS_CODE} AS text FROM pages),
 l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM t)"""


def code_lines(spark, sf):
    pages = texts(spark, sf, "pages", "page_id")
    return audit.lines(pages.withColumn("text", F.concat_ws("\n", F.col("url"), F.expr(_AS_CODE.replace("''", "\\'")))), "page_id", "text")


@query("audit_open_tasks", _CODE_LINES + """
 SELECT doc_id, line_no, unnest(list_filter([CASE WHEN contains(line, 'TODO:') THEN 'todo' END, CASE WHEN contains(line, 'FIXME:') THEN 'fixme' END,
  CASE WHEN contains(line, 'HACK:') THEN 'hack' END, CASE WHEN contains(line, 'XXX:') THEN 'xxx' END], lambda x: x IS NOT NULL)) AS finding FROM l""")
def audit_open_tasks(spark, sf):
    return audit.open_tasks(code_lines(spark, sf)).select(F.col("path").alias("doc_id"), "line_no", "finding")


@query("audit_undeclared", _CODE_LINES + r""",
 w AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, 'os\.getenv\(["'']([^"'']+)["'']', 1)) AS name FROM l),
 k AS (SELECT DISTINCT lang AS name FROM documents)
 SELECT name, doc_id, line_no FROM w WHERE name NOT IN (FROM k)""")
def audit_undeclared(spark, sf):
    rows = code_lines(spark, sf)
    declared = table(spark, sf, "documents").select(F.col("lang").alias("line"))
    return audit.undeclared(rows, declared).select("name", F.col("path").alias("doc_id"), "line_no")


_TERMS = terminology.Dictionary({"la": "the", "der": "the"}, {"et": "and"}, {"the": ("das", "der")}, {}, {}, {})


@query("term_variations", """WITH v AS (SELECT * FROM (VALUES ('the', 'the'), ('the', 'la'), ('the', 'der'), ('the', 'das'),
   ('and', 'and'), ('and', 'et')) t(standard_term, variation))
 SELECT standard_term, string_agg(variation, '|' ORDER BY variation) AS variations FROM v
 WHERE (SELECT bool_or(contains(text, standard_term)) FROM documents) GROUP BY standard_term""")
def term_variations(spark, sf):
    """Variations of the standard terms that some document names."""
    known = terminology.variation_table(spark, _TERMS)
    words = F.array(F.lit("the"), F.lit("and"))
    named = texts(spark, sf).select(F.explode(F.filter(words, lambda t: F.contains(F.col("text"), t))).alias("standard_term"))
    out = terminology.variations(named.distinct(), known)
    return out.select("standard_term", F.array_join("variations", "|").alias("variations"))
