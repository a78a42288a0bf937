"""Query analysis, weighting and query transformation.

Queries are the ``benchmark`` texts and the user turns of ``conversations``.
The performance history is read from ``events``: the event type names the path,
the value becomes the metrics and the user gives the context.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusweir import lexicon as L
from corpusweir.catalog import clinical as K
from corpusweir.catalog import sql as S
from corpusweir.catalog.registry import query, table
from corpusweir.config import DEFAULT_WEIGHTS, PATHS
from corpusweir.functions.text import WS, tokens
from corpusweir.operators import analysis, keywords, weights


def all_queries(spark, sf):
    bench = table(spark, sf, "benchmark").select(
        F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("query_id"), "text")
    conv = table(spark, sf, "conversations").filter("role = 'user'").select(
        F.format_string("c%d-%d", "conv_id", "turn").alias("query_id"), "text")
    return bench.unionByName(conv)


_Q = """WITH q AS (SELECT 'b' || item_id AS query_id, text FROM benchmark
  UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations WHERE role = 'user')"""


def _in(terms):
    return "(" + ", ".join(f"'{t}'" for t in terms) + ")"


def _hits(patterns):
    return " + ".join(
        rf"regexp_matches(low, '(^|[^\p{{L}}\p{{N}}_])({p})($|[^\p{{L}}\p{{N}}_])')::INT" for p in patterns)


_RUNS = r"[^\p{L}\p{N}_]+"
LOW = _Q + f""",
 l AS (SELECT query_id, text, {S.strip('lower(text)')} AS low FROM q),
 t AS (SELECT *, {_hits(L.FACTUAL)} AS f, {_hits(L.PROCEDURAL)} AS p, {_hits(L.COMPARATIVE)} AS c,
   {_hits(L.TEMPORAL)} AS tm, regexp_matches(low, '\\p{{Nd}}')::INT + {_hits(L.NUMERICAL)} AS n FROM l),
 ty AS (SELECT *, CASE WHEN greatest(f, p, c, tm, n) = 0 THEN 'conceptual'
   WHEN (f = greatest(f, p, c, tm, n))::INT + (p = greatest(f, p, c, tm, n))::INT + (c = greatest(f, p, c, tm, n))::INT
     + (tm = greatest(f, p, c, tm, n))::INT + (n = greatest(f, p, c, tm, n))::INT > 1 THEN 'mixed'
   WHEN f = greatest(f, p, c, tm, n) THEN 'factual' WHEN p = greatest(f, p, c, tm, n) THEN 'procedural'
   WHEN c = greatest(f, p, c, tm, n) THEN 'comparative' WHEN tm = greatest(f, p, c, tm, n) THEN 'temporal'
   ELSE 'numerical' END AS query_type,
   len({S.words('text')}) + 2 * len(list_filter(string_split_regex(lower(text), '{_RUNS}'),
     lambda x: x IN {_in(L.CONJUNCTIONS)})) + len(regexp_extract_all(text, '\\?')) AS cs,
   {S.words('low')} AS w,
   list_filter(string_split_regex(low, '{_RUNS}'), lambda x: length(x) > 2 AND x NOT IN {_in(L.STOP_WORDS)}) AS kept,
   regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+') AS parts FROM t),
 ek AS (SELECT *, CASE WHEN cs <= 5 THEN 'simple' WHEN cs <= 15 THEN 'moderate' ELSE 'complex' END AS complexity,
   list_transform(list_sort(list_transform(list_distinct(kept), lambda x: {{'n': -len(list_filter(kept, lambda y: y = x)),
     'i': list_position(kept, x), 'w': x}}))[1:10], lambda s: s.w) AS keywords,
   list_filter(list_transform(string_split(array_to_string(list_transform(parts, lambda x: CASE
     WHEN regexp_matches(x, '^[A-Z][a-z]+$') OR regexp_matches(x, '^{WS}+$') THEN x ELSE chr(1) END), ''), chr(1)),
     lambda x: {S.strip('x')}), lambda x: x <> '') AS nouns,
   list_filter(parts, lambda x: regexp_matches(x, '^\\p{{Nd}}{{4}}$')) AS years,
   list_filter(parts, lambda x: regexp_matches(x, '^[A-Z]{{2,}}$')) AS acronyms,
   CASE WHEN len(w) = 0 THEN 0 ELSE least(len(list_filter(w, lambda x: x IN {_in(L.SEMANTIC_WORDS)})) / len(w)::DOUBLE * 3, 1) END AS sd,
   CASE WHEN len(w) = 0 THEN 0 ELSE least(len(list_filter(w, lambda x: length(x) > 6)) / len(w)::DOUBLE * 2, 1) END AS kd FROM ty),
 an AS (SELECT *, list_transform(list_sort(list_transform(list_filter(
     list_distinct(list_concat(list_concat(nouns, years), acronyms)),
     lambda x: length(x) > 1 AND lower(x) NOT IN {_in(L.STOP_WORDS)}), lambda x: {{'p': instr(text, x), 'e': x}}))[1:10],
     lambda s: s.e) AS entities FROM ek),
 cf AS (SELECT *, least(0.5 + CASE WHEN query_type <> 'mixed' THEN 0.2 ELSE 0 END
   + CASE complexity WHEN 'simple' THEN 0.2 WHEN 'moderate' THEN 0.1 ELSE 0 END
   + least(len(entities) * 0.05, 0.2) + least(len(keywords) * 0.03, 0.15), 1.0)::DOUBLE AS confidence FROM an),
 r0 AS (SELECT *, (0.3 + CASE query_type WHEN 'factual' THEN -0.1 WHEN 'conceptual' THEN 0.2 WHEN 'procedural' THEN -0.1
     WHEN 'comparative' THEN 0.15 ELSE 0 END + CASE complexity WHEN 'complex' THEN 0.1 ELSE 0 END + 0.2 * sd)::DOUBLE AS rv,
   (0.25 + CASE query_type WHEN 'factual' THEN 0.2 WHEN 'conceptual' THEN -0.1 WHEN 'comparative' THEN -0.1 ELSE 0 END
     + CASE complexity WHEN 'simple' THEN 0.1 ELSE 0 END + 0.2 * kd)::DOUBLE AS rk,
   (0.25 + CASE query_type WHEN 'factual' THEN 0.1 WHEN 'procedural' THEN 0.1 ELSE 0 END
     + CASE complexity WHEN 'simple' THEN 0.05 ELSE 0 END)::DOUBLE AS rs,
   (0.2 + CASE query_type WHEN 'conceptual' THEN 0.1 WHEN 'procedural' THEN 0.2 WHEN 'comparative' THEN 0.15 ELSE 0 END
     + CASE complexity WHEN 'complex' THEN 0.1 ELSE 0 END)::DOUBLE AS rc FROM cf),
 rt AS (SELECT *, rv / (rv + rk + rs + rc) AS wv, rk / (rv + rk + rs + rc) AS wk, rs / (rv + rk + rs + rc) AS ws,
   rc / (rv + rk + rs + rc) AS wc FROM r0)"""


def r6(col, name):
    return F.round(col, 6).alias(name)


@query("query_analysis", LOW + """
 SELECT query_id, query_type, complexity, array_to_string(entities, '|') AS entities,
  array_to_string(keywords, '|') AS keywords, round(sd, 6) AS semantic_density, round(kd, 6) AS keyword_density,
  round(confidence, 6) AS confidence FROM rt""")
def query_analysis(spark, sf):
    out = analysis.analyse(all_queries(spark, sf))
    return out.select(
        "query_id", "query_type", "complexity", F.array_join("entities", "|").alias("entities"),
        F.array_join("keywords", "|").alias("keywords"), r6(F.col("semantic_density"), "semantic_density"),
        r6(F.col("keyword_density"), "keyword_density"), r6(F.col("confidence"), "confidence"))


@query("query_router", LOW + """
 SELECT query_id, round(wv, 6) AS vector, round(wk, 6) AS keywords, round(ws, 6) AS summary, round(wc, 6) AS content,
  array_to_string(list_filter(['vector', 'keywords', 'summary', 'content'], lambda p: CASE p WHEN 'vector' THEN wv
   WHEN 'keywords' THEN wk WHEN 'summary' THEN ws ELSE wc END > 0.1), '|') AS recommended FROM rt""")
def query_router(spark, sf):
    out = analysis.analyse(all_queries(spark, sf))
    return out.select("query_id", *[r6(F.col(f"w_{p}"), p) for p in PATHS],
                      F.array_join("recommended_paths", "|").alias("recommended"))


@query("blended_weights", LOW + """,
 m AS (SELECT query_id, 0.4 * (1 - confidence) + wv * confidence AS v, 0.3 * (1 - confidence) + wk * confidence AS k,
   0.2 * (1 - confidence) + ws * confidence AS s, 0.1 * (1 - confidence) + wc * confidence AS c FROM rt)
 SELECT query_id, round(v / (v + k + s + c), 6) AS vector, round(k / (v + k + s + c), 6) AS keywords,
  round(s / (v + k + s + c), 6) AS summary, round(c / (v + k + s + c), 6) AS content FROM m""")
def blended_weights(spark, sf):
    out = analysis.blended_weights(analysis.analyse(all_queries(spark, sf)), DEFAULT_WEIGHTS)
    return out.select("query_id", *[r6(F.col(f"a_{p}"), p) for p in PATHS])


def contexts(spark, sf):
    return analysis.query_contexts(analysis.analyse(all_queries(spark, sf)))


# Event type -> path; errors record nothing.
EVENT_PATHS = {"click": "vector", "view": "keywords", "purchase": "summary", "signup": "content"}
EVENT_TYPES = {0: "conceptual", 1: "mixed", 2: "numerical", 3: "procedural"}


def history(spark, sf):
    ev = table(spark, sf, "events").filter("event_type <> 'error'")
    path = F.coalesce(*[F.when(F.col("event_type") == e, F.lit(p)) for e, p in EVENT_PATHS.items()])
    share = F.least(F.col("value") / 100, F.lit(1.0))
    bucket = F.pmod("user_id", F.lit(4))
    return ev.select(
        F.col("event_id").alias("record_id"), "ts", path.alias("path"),
        F.coalesce(*[F.when(bucket == k, F.lit(t)) for k, t in EVENT_TYPES.items()]).alias("query_type"),
        F.when(F.pmod("user_id", F.lit(3)) == 0, "moderate").otherwise("complex").alias("complexity"),
        (F.pmod("user_id", F.lit(10)) / 10).alias("semantic_density"),
        share.alias("precision_at_k"), (1 - share).alias("recall_at_k"), (F.col("value") / 50).alias("response_time"),
        F.lit(1.0).alias("success_rate"), (share / 2).alias("user_satisfaction"), share.alias("relevance_score"),
        F.lit(0.5).alias("diversity_score"))


_H = """,
 h0 AS (SELECT event_id AS record_id, ts, CASE event_type WHEN 'click' THEN 'vector' WHEN 'view' THEN 'keywords'
   WHEN 'purchase' THEN 'summary' ELSE 'content' END AS path,
   CASE user_id % 4 WHEN 0 THEN 'conceptual' WHEN 1 THEN 'mixed' WHEN 2 THEN 'numerical' ELSE 'procedural' END AS query_type,
   CASE WHEN user_id % 3 = 0 THEN 'moderate' ELSE 'complex' END AS complexity, (user_id % 10) / 10.0::DOUBLE AS d,
   least(value / 100, 1) AS sh, value / 50 AS rt FROM events WHERE event_type <> 'error'),
 h AS (SELECT * FROM h0 QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, record_id DESC) <= 100)"""
_SCORE = """avg(sh) * 0.25 + (1 - avg(sh)) * 0.20 + (1 - least(avg(rt) / 5.0, 1.0)) * 0.15 + 0.15 + avg(sh) / 2 * 0.10
   + avg(sh) * 0.10 + 0.5 * 0.05"""


@query("path_performance", "WITH z AS (SELECT 1)" + _H + f"""
 SELECT path, count(*) AS n, round(avg(sh), 6) AS precision_at_k, round(avg(rt), 6) AS response_time,
  round({_SCORE}, 6) AS overall FROM h GROUP BY path""")
def path_performance(spark, sf):
    recent = weights.recent(history(spark, sf))
    sizes = recent.groupBy("path").agg(F.count("*").alias("n"))
    avg = weights.average_performance(recent, ["path"]).join(sizes, "path")
    return avg.select("path", "n", r6(F.col("precision_at_k"), "precision_at_k"),
                      r6(F.col("response_time"), "response_time"), r6(weights.overall_score(), "overall"))


_RANKED = LOW + _H + f""",
 cm AS (SELECT rt.query_id, h.path, {_SCORE} AS score FROM rt JOIN h ON h.query_type = rt.query_type
   AND h.complexity = rt.complexity AND abs(h.d - rt.sd) < 0.3 GROUP BY ALL),
 gr AS (SELECT query_id, i, path, round(coalesce(score, 0.15), 9) AS score FROM
   (SELECT query_id, i, path FROM rt, (VALUES (0, 'vector'), (1, 'keywords'), (2, 'summary'), (3, 'content')) v(i, path))
   LEFT JOIN cm USING (query_id, path)),
 pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, i) - 1 AS place FROM gr)"""


@query("path_rankings", _RANKED + " SELECT query_id, path, round(score, 6) AS score, place FROM pl")
def path_rankings(spark, sf):
    out = weights.path_rankings(contexts(spark, sf), history(spark, sf))
    return out.select("query_id", "path", r6(F.col("score"), "score"), F.col("place").cast("long").alias("place"))


def _qa(path, base):
    """SQL of the query-aware weight of a path."""
    pattern = " ".join(
        f"WHEN '{t}' THEN {base * 0.7 + w[path] * 0.3!r}" for t, w in weights.TYPE_PATTERNS.items())
    factor = {
        "vector": "CASE complexity WHEN 'simple' THEN 0.9 WHEN 'complex' THEN 1.3 ELSE 1 END * CASE WHEN sd > 0.7 THEN 1.2 ELSE 1 END",
        "keywords": "CASE complexity WHEN 'simple' THEN 1.2 WHEN 'complex' THEN 0.8 ELSE 1 END * CASE WHEN sd < 0.3 THEN 1.2 ELSE 1 END"
                    " * CASE WHEN len(entities) > 0 THEN 1.1 ELSE 1 END",
        "summary": "CASE complexity WHEN 'complex' THEN 1.1 ELSE 1 END",
        "content": r"CASE WHEN regexp_matches(text, '\p{Nd}') THEN 1.2 ELSE 1 END",
    }[path]
    return f"(CASE query_type {pattern} ELSE {base} END * {factor})::DOUBLE"


def _finish(v, k, s, c, source):
    return f""",
 fi AS (SELECT query_id, {v} AS v, {k} AS k, {s} AS s, {c} AS c FROM {source}),
 f1 AS (SELECT query_id, greatest(0.05, least(0.7, v / (v + k + s + c))) AS v, greatest(0.05, least(0.7, k / (v + k + s + c))) AS k,
   greatest(0.05, least(0.7, s / (v + k + s + c))) AS s, greatest(0.05, least(0.7, c / (v + k + s + c))) AS c FROM fi)
 SELECT query_id, round(v / (v + k + s + c), 6) AS vector, round(k / (v + k + s + c), 6) AS keywords,
  round(s / (v + k + s + c), 6) AS summary, round(c / (v + k + s + c), 6) AS content FROM f1"""


QUERY_AWARE = {p: _qa(p, DEFAULT_WEIGHTS[p]) for p in PATHS}


@query("weights_query_aware", LOW + _finish(*[QUERY_AWARE[p] for p in PATHS], "rt"))
def weights_query_aware(spark, sf):
    out = weights.adjust(contexts(spark, sf), DEFAULT_WEIGHTS, "query_aware")
    return out.select("query_id", *[r6(F.col(f"f_{p}"), p) for p in PATHS])


def _perf(path):
    return f"{DEFAULT_WEIGHTS[path]} + sum(CASE WHEN path = '{path}' THEN 0.1 * (4 - place) / 4.0 * score ELSE 0 END)"


_PERF = ", ".join(f"({_perf(p)})::DOUBLE AS p_{p}" for p in PATHS)


@query("weights_by_performance", _RANKED + f""",
 pw AS (SELECT query_id, {_PERF} FROM pl GROUP BY query_id)""" + _finish("p_vector", "p_keywords", "p_summary", "p_content", "pw"))
def weights_by_performance(spark, sf):
    out = weights.adjust(contexts(spark, sf), DEFAULT_WEIGHTS, "performance_based", history(spark, sf))
    return out.select("query_id", *[r6(F.col(f"f_{p}"), p) for p in PATHS])


_HY = ", ".join(f"(0.3 * p_{p} + 0.7 * {QUERY_AWARE[p]}) AS h_{p}" for p in PATHS)


@query("weights_hybrid", _RANKED + f""",
 pw AS (SELECT query_id, {_PERF} FROM pl GROUP BY query_id),
 hy AS (SELECT query_id, {_HY} FROM rt JOIN pw USING (query_id))"""
       + _finish("h_vector", "h_keywords", "h_summary", "h_content", "hy"))
def weights_hybrid(spark, sf):
    out = weights.adjust(contexts(spark, sf), DEFAULT_WEIGHTS, "hybrid", history(spark, sf))
    return out.select("query_id", *[r6(F.col(f"f_{p}"), p) for p in PATHS])


@query("weights_reinforcement", "WITH z AS (SELECT 1)" + _H + """,
 n AS (SELECT d10 FROM (SELECT (d * 10)::INT || '' AS d10, max(ts) AS t FROM h0 GROUP BY 1) ORDER BY t DESC, d10 DESC LIMIT 4),
 rw AS (SELECT path, sh * 0.25 + (1 - sh) * 0.20 + (1 - least(rt / 5.0, 1.0)) * 0.15 + 0.15 + sh / 2 * 0.10 + sh * 0.10
   + 0.5 * 0.05 AS r FROM h0 WHERE (d * 10)::INT || '' IN (FROM n))
 SELECT round(0.4 + 0.1 * (avg(r) FILTER (path = 'vector') - 0.5), 6) AS vector,
  round(0.3 + 0.1 * (avg(r) FILTER (path = 'keywords') - 0.5), 6) AS keywords,
  round(0.2 + 0.1 * (avg(r) FILTER (path = 'summary') - 0.5), 6) AS summary,
  round(0.1 + 0.1 * (avg(r) FILTER (path = 'content') - 0.5), 6) AS content FROM rw""")
def weights_reinforcement(spark, sf):
    feedback = history(spark, sf).withColumn(
        "adjustment_id", F.round(F.col("semantic_density") * 10).cast("int").cast("string"))
    out = weights.reinforcement(DEFAULT_WEIGHTS, feedback, 4)
    return out.select(*[r6(F.col(p), p) for p in PATHS])


@query("weights_reinforced", "WITH z AS (SELECT 1)" + _H + """,
 n AS (SELECT user_id FROM events WHERE event_type <> 'error' GROUP BY user_id ORDER BY max(ts) DESC, user_id DESC LIMIT 10),
 rw AS (SELECT path, sh * 0.25 + (1 - sh) * 0.20 + (1 - least(rt / 5.0, 1.0)) * 0.15 + 0.15 + sh / 2 * 0.10 + sh * 0.10
   + 0.5 * 0.05 AS r FROM h0 JOIN events e ON e.event_id = h0.record_id WHERE e.user_id IN (FROM n)),
 w AS (SELECT 0.4 + 0.1 * coalesce(avg(r) FILTER (path = 'vector') - 0.5, 0) AS v, 0.3 + 0.1 * coalesce(avg(r) FILTER (path = 'keywords') - 0.5, 0) AS k,
   0.2 + 0.1 * coalesce(avg(r) FILTER (path = 'summary') - 0.5, 0) AS s, 0.1 + 0.1 * coalesce(avg(r) FILTER (path = 'content') - 0.5, 0) AS c FROM rw),
 f1 AS (SELECT greatest(0.05, least(0.7, v / (v + k + s + c))) AS v, greatest(0.05, least(0.7, k / (v + k + s + c))) AS k,
   greatest(0.05, least(0.7, s / (v + k + s + c))) AS s, greatest(0.05, least(0.7, c / (v + k + s + c))) AS c FROM w)
 SELECT 'b' || item_id AS query_id, round(v / (v + k + s + c), 6) AS vector, round(k / (v + k + s + c), 6) AS keywords,
  round(s / (v + k + s + c), 6) AS summary, round(c / (v + k + s + c), 6) AS content FROM f1, benchmark
 UNION ALL SELECT 'c' || conv_id || '-' || turn, round(v / (v + k + s + c), 6), round(k / (v + k + s + c), 6),
  round(s / (v + k + s + c), 6), round(c / (v + k + s + c), 6) FROM f1, conversations WHERE role = 'user'""")
def weights_reinforced(spark, sf):
    users = table(spark, sf, "events").select(F.col("event_id").alias("record_id"), F.col("user_id").alias("adjustment_id"))
    feedback = history(spark, sf).join(users, "record_id")
    out = weights.adjust(contexts(spark, sf), DEFAULT_WEIGHTS, "reinforcement", feedback=feedback)
    return out.select("query_id", *[r6(F.col(f"f_{p}"), p) for p in PATHS])


@query("adaptation_stats", "WITH z AS (SELECT 1)" + _H + """,
 mx AS (SELECT max(ts) AS t FROM h0)
 SELECT query_type AS strategy, path, count(*) AS adjustments, round(avg(sh - d), 6) AS average_change,
  count(*) FILTER (epoch(t) - epoch(ts) < 3600) AS recent_adjustments FROM h0, mx GROUP BY ALL""")
def adaptation_stats(spark, sf):
    adj = history(spark, sf).select(
        F.col("record_id").alias("adjustment_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("query_type").alias("strategy"), "path",
        F.col("semantic_density").alias("original"), F.col("precision_at_k").alias("adjusted"))
    now = adj.agg(F.max("ts")).scalar()
    out = weights.adaptation_stats(adj, now)
    return out.withColumn("average_change", F.round("average_change", 6))


# ------------------------------------------------------------------ service level (Q14, Q15)


@query("service_analysis", _Q + f"""
 SELECT query_id, 'general' AS query_type, 'en' AS language,
  CASE WHEN contains(text, '?') OR contains(text, '？') THEN 'question' ELSE 'statement' END AS intent,
  CASE WHEN len({S.words('text')}) < 5 THEN 'simple' WHEN len({S.words('text')}) < 15 THEN 'medium' ELSE 'complex' END AS complexity,
  array_to_string(list_filter({S.words('text')}, lambda x: lower(x) NOT IN ('a', 'an', 'the') AND length(x) > 1)[1:10], '|') AS keywords
 FROM q""")
def service_analysis(spark, sf):
    out = analysis.service_analysis(all_queries(spark, sf))
    return out.select("query_id", "query_type", "language", "intent", "complexity",
                      F.array_join("keywords", "|").alias("keywords"))


@query("search_suggestions", _Q + """
 SELECT query_id, pos, md5(text || s) AS suggestion FROM q,
  (VALUES (0, '的症状'), (1, '的治疗方法'), (2, '的诊断标准'), (3, '的预防措施')) v(pos, s)""")
def search_suggestions(spark, sf):
    out = analysis.suggestions(all_queries(spark, sf))
    return out.withColumn("suggestion", F.md5("suggestion"))


_ASKED = _Q + f", a AS (SELECT query_id, {K.in_other_words(K.ASKED)} AS text, length(text) % 3 AS kind FROM q)"


def asked(spark, sf):
    """The queries with frequent words turned into those of the lexicons, and a number that picks their context."""
    return all_queries(spark, sf).select("query_id", F.expr(K.in_other_words(K.ASKED)).alias("text"), (F.length("text") % 3).alias("kind"))


def _put(patterns, text: str) -> str:
    return "[" + ", ".join(f"'{p.split('{}')[0]}' || {text} || '{p.split('{}')[1]}'" for p in patterns) + "]"


def _variants() -> str:
    lists = ["[text]"]
    for term, options in (*L.QUERY_SYNONYMS.items(), *L.QUERY_EXPANSIONS.items()):
        put = ", ".join(f"replace(text, '{term}', '{o}')" for o in options)
        lists.append(f"CASE WHEN contains(text, '{term}') THEN [{put}] ELSE [] END")
    marks = " OR ".join(f"contains(text, '{m}')" for m in L.QUESTION_MARKS)

    def bare(word):
        return f"regexp_replace(replace(text, '{word}', ''), '[？?]', '', 'g')"

    lists.append(f"CASE WHEN NOT ({marks}) THEN {_put(L.STATEMENT_VARIANTS, 'text')} WHEN starts_with(text, '什么是') THEN "
                 f"{_put(L.DEFINITION_VARIANTS, bare('什么是'))} WHEN contains(text, '如何') THEN {_put(L.HOWTO_VARIANTS, bare('如何'))} ELSE [] END")
    return " || ".join(lists)


_PUT = "CASE kind WHEN 0 THEN '什么是' || text || '？' WHEN 1 THEN '如何 ' || text ELSE text END"


@query("expand_queries", _ASKED + f""",
 x AS (SELECT query_id, {_PUT} AS text FROM a), l AS (SELECT query_id, {_variants()} AS vs FROM x),
 v AS (SELECT query_id, unnest(vs) AS variant, generate_subscripts(vs, 1) AS i FROM l)
 SELECT query_id, variant FROM (SELECT query_id, variant, min(i) AS i FROM v GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY i) <= 5""")
def expand_queries(spark, sf):
    put = asked(spark, sf).select("query_id", F.expr(_PUT).alias("text"))
    return put.select("query_id", F.explode(analysis.expand(F.col("text"))).alias("variant"))


def _renamed(text: str) -> str:
    for old, new in L.REWRITE_TERMS.items():
        text = f"replace({text}, '{old}', '{new}')"
    return text


@query("rewrite_queries", _ASKED + f""",
 w AS (SELECT query_id, kind, array_to_string(list_filter({S.words('text')}, lambda x: x NOT IN {_in(L.REWRITE_STOP_WORDS)}), ' ') AS o FROM a),
 r AS (SELECT query_id, kind, {_renamed('o')} AS o FROM w),
 p AS (SELECT query_id, kind, CASE WHEN kind < 2 AND NOT contains(o, '患者') THEN '患者 ' || o ELSE o END AS o FROM r)
 SELECT query_id, CASE WHEN kind > 0 AND NOT contains(o, '治疗') THEN o || ' 治疗' ELSE o END AS rewritten FROM p""")
def rewrite_queries(spark, sf):
    context = F.when(F.col("kind") == 0, "患者咨询").when(F.col("kind") == 1, "患者治疗").otherwise("治疗")
    return asked(spark, sf).select("query_id", analysis.rewrite(F.col("text"), context).alias("rewritten"))


@query("query_entity_classes", _ASKED + " SELECT query_id, " + ", ".join(
    f"array_to_string(list_filter([{', '.join(repr(t) for t in terms)}], lambda x: contains(lower(text), x)), '|') AS {name}"
    for name, terms in L.QUERY_ENTITIES.items()) + " FROM a")
def query_entity_classes(spark, sf):
    found = analysis.query_entities(F.col("text"))
    return asked(spark, sf).select("query_id", *[F.array_join(c, "|").alias(n) for n, c in found.items()])


@query("frequent_terms", f"""WITH t AS (SELECT doc_id, unnest({S.tok('text')}) AS term,
   generate_subscripts({S.tok('text')}, 1) - 1 AS pos FROM documents),
 c AS (SELECT doc_id, term, count(*) AS n, min(pos) AS first_pos FROM t GROUP BY ALL)
 SELECT doc_id, term, n, first_pos, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) AS rank
 FROM c QUALIFY rank <= 10""")
def frequent_terms(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", tokens(F.col("text")).alias("terms"))
    return keywords.frequent_terms(docs, ["doc_id"], 10)
