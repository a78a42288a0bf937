"""Query analysis: type, complexity, entities, densities and path weights.

All of it is one projection over the queries; nothing is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweir import lexicon as L
from corpusweir.config import PATHS
from corpusweir.functions.text import CJK, WS, computed, contains_any, count_chars, count_matches, has_word, safe_div, strip, word_runs, words

# Base weights, and what each query type and complexity adds.
ROUTER_BASE = {"vector": 0.3, "keywords": 0.25, "summary": 0.25, "content": 0.2}
TYPE_DELTAS = {
    "factual": {"keywords": 0.2, "summary": 0.1, "vector": -0.1},
    "conceptual": {"vector": 0.2, "content": 0.1, "keywords": -0.1},
    "procedural": {"content": 0.2, "summary": 0.1, "vector": -0.1},
    "comparative": {"vector": 0.15, "content": 0.15, "keywords": -0.1},
}
COMPLEXITY_DELTAS = {
    "simple": {"keywords": 0.1, "summary": 0.05},
    "complex": {"vector": 0.1, "content": 0.1},
}
DENSITY_SHARE = 0.2
# The boundaries are spelled out: every regex dialect reads them the same way.
EDGE_L, EDGE_R = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
ENTITY_PATTERNS = (
    rf"{EDGE_L}[A-Z][a-z]+(?:{WS}+[A-Z][a-z]+)*{EDGE_R}",
    rf"{EDGE_L}\p{{Nd}}{{4}}{EDGE_R}",
    rf"{EDGE_L}[A-Z]{{2,}}{EDGE_R}",
)
MAX_ENTITIES = MAX_KEYWORDS = 10


def _add(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def query_type(low: Column, runs: Column) -> Column:
    """Type with most matching patterns; none is conceptual, a tie is mixed.

    Single words are looked up in the word runs; only phrases need a regex.
    """
    def hits(patterns):
        single = [p for p in patterns if " " not in p]
        found = F.size(F.array_intersect(runs, F.array(*[F.lit(p) for p in single])))
        return _add([found] + [has_word(low, p).cast("int") for p in patterns if " " in p])

    scores = {
        "factual": hits(L.FACTUAL),
        "procedural": hits(L.PROCEDURAL),
        "comparative": hits(L.COMPARATIVE),
        "temporal": hits(L.TEMPORAL),
        "numerical": hits(L.NUMERICAL) + low.rlike(r"\p{Nd}").cast("int"),
    }
    best = F.greatest(*scores.values())
    tied = _add([(s == best).cast("int") for s in scores.values()])
    out = F.when(best == 0, "conceptual").when(tied > 1, "mixed")
    for name, score in scores.items():
        out = out.when(score == best, name)
    return out


def complexity(text: Column, runs: Column) -> Column:
    joined = F.size(F.filter(runs, lambda w: w.isin(*L.CONJUNCTIONS)))
    score = F.size(words(text)) + 2 * joined + count_matches(text, r"\?")
    return F.when(score <= 5, "simple").when(score <= 15, "moderate").otherwise("complex")


def entities(text: Column) -> Column:
    """Proper nouns, years and acronyms by first position, at most ten."""
    found = F.array_distinct(F.concat(*[
        F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in ENTITY_PATTERNS
    ]))
    kept = F.filter(found, lambda e: (F.length(e) > 1) & ~F.lower(e).isin(*L.STOP_WORDS))
    placed = F.array_sort(F.transform(
        kept, lambda e: F.struct(F.position(e, text).alias("p"), e.alias("e"))
    ))
    return F.slice(F.transform(placed, lambda s: s["e"]), 1, MAX_ENTITIES)


def keywords(runs: Column) -> Column:
    """Most frequent words of the query, first occurrence breaking ties."""
    kept = F.filter(runs, lambda w: (F.length(w) > 2) & ~w.isin(*L.STOP_WORDS))
    counted = F.transform(F.array_distinct(kept), lambda w, i: F.struct(
        (-F.size(F.filter(kept, lambda x: x == w))).alias("n"), i.alias("i"), w.alias("w")
    ))
    return F.slice(F.transform(F.array_sort(counted), lambda s: s["w"]), 1, MAX_KEYWORDS)


def semantic_density(low: Column) -> Column:
    w = words(low)
    hits = F.size(F.filter(w, lambda x: x.isin(*L.SEMANTIC_WORDS)))
    return F.least(safe_div(hits, F.size(w)) * 3, F.lit(1.0))


def keyword_density(low: Column) -> Column:
    w = words(low)
    return F.least(safe_div(F.size(F.filter(w, lambda x: F.length(x) > 6)), F.size(w)) * 2, F.lit(1.0))


def _delta(selector: Column, table: dict[str, dict[str, float]], path: str) -> Column:
    out = F.lit(0.0)
    for name, deltas in table.items():
        if path in deltas:
            out = F.when(selector == name, F.lit(deltas[path])).otherwise(out)
    return out


def analyse(queries: DataFrame) -> DataFrame:
    """``queries(query_id, text)`` with every analysis column and ``w_<path>`` weights."""
    out = computed(queries, {"_low": strip(F.lower("text"))})
    out = computed(out, {"_runs": word_runs(F.col("_low"))})
    out = computed(out, {
        "query_type": query_type(F.col("_low"), F.col("_runs")),
        "complexity": complexity(F.col("text"), F.col("_runs")),
        "entities": entities(F.col("text")),
        "keywords": keywords(F.col("_runs")),
        "semantic_density": semantic_density(F.col("_low")),
        "keyword_density": keyword_density(F.col("_low")),
    })
    raw = {}
    for path in PATHS:
        w = (F.lit(ROUTER_BASE[path]) + _delta(F.col("query_type"), TYPE_DELTAS, path)
             + _delta(F.col("complexity"), COMPLEXITY_DELTAS, path))
        if path == "vector":
            w = w + DENSITY_SHARE * F.col("semantic_density")
        if path == "keywords":
            w = w + DENSITY_SHARE * F.col("keyword_density")
        raw[f"_r_{path}"] = w
    out = out.withColumns(raw)
    total = _add([F.col(c) for c in raw])
    out = out.withColumns({f"w_{p}": F.col(f"_r_{p}") / total for p in PATHS}).drop(*raw)
    out = out.withColumn("confidence", confidence(
        F.col("query_type"), F.col("complexity"), F.size("entities"), F.size("keywords")
    ))
    return out.withColumn("recommended_paths", recommended(out)).drop("_low", "_runs")


def query_contexts(analysed: DataFrame) -> DataFrame:
    """What the weight adjustment looks at."""
    dates = rf"{EDGE_L}\p{{Nd}}{{4}}{EDGE_R}|{EDGE_L}\p{{Nd}}{{1,2}}/\p{{Nd}}{{1,2}}/\p{{Nd}}{{2,4}}{EDGE_R}"
    return analysed.select(
        "query_id", "query_type", "complexity", "semantic_density",
        (F.size("entities") > 0).alias("has_entities"),
        F.col("text").rlike(r"\p{Nd}").alias("has_numbers"), F.col("text").rlike(dates).alias("has_dates"),
    )


def confidence(qtype: Column, level: Column, n_entities: Column, n_keywords: Column) -> Column:
    value = (
        F.lit(0.5)
        + F.when(qtype != "mixed", 0.2).otherwise(0.0)
        + F.when(level == "simple", 0.2).when(level == "moderate", 0.1).otherwise(0.0)
        + F.least(n_entities * 0.05, F.lit(0.2))
        + F.least(n_keywords * 0.03, F.lit(0.15))
    )
    return F.least(value, F.lit(1.0))


def recommended(df: DataFrame) -> Column:
    """Paths weighing more than 0.1; the two heaviest when fewer are left."""
    listed = F.array(*[
        F.struct((-F.col(f"w_{p}")).alias("o"), F.lit(i).alias("i"), F.lit(p).alias("p"))
        for i, p in enumerate(PATHS)
    ])
    heavy = F.filter(listed, lambda s: s["o"] < -0.1)
    best = F.slice(F.array_sort(listed), 1, 2)
    return F.transform(F.when(F.size(heavy) >= 2, heavy).otherwise(best), lambda s: s["p"])


def blended_weights(analysed: DataFrame, base: dict[str, float]) -> DataFrame:
    """Configured and recommended weights mixed by confidence, then normalised."""
    mixed = {
        f"_m_{p}": F.lit(float(base.get(p, 0.0))) * (1 - F.col("confidence"))
        + F.col(f"w_{p}") * F.col("confidence")
        for p in PATHS
    }
    out = analysed.withColumns(mixed)
    total = _add([F.col(c) for c in mixed])
    return out.withColumns({
        f"a_{p}": F.when(total > 0, F.col(f"_m_{p}") / F.nullif(total, F.lit(0.0))).otherwise(F.col(f"_m_{p}"))
        for p in PATHS
    }).drop(*mixed)


def as_rows(df: DataFrame, prefix: str) -> DataFrame:
    """Weight columns to (query_id, path, weight)."""
    return df.select("query_id", F.explode(F.array(*[
        F.struct(F.lit(p).alias("path"), F.col(f"{prefix}{p}").alias("weight")) for p in PATHS
    ])).alias("w")).select("query_id", "w.path", "w.weight")


# --------------------------------------------------------------- service level


def service_analysis(queries: DataFrame) -> DataFrame:
    """Type, language, intent, complexity and keywords as the search service reports them."""
    text, low = F.col("text"), F.lower("text")
    size = F.size(words(text))
    trimmed = F.length(strip(text))
    return queries.withColumns({
        "query_type": F.when(contains_any(low, L.SERVICE_DEFINITION), "definition")
        .when(contains_any(low, L.SERVICE_SYMPTOM), "symptom")
        .when(contains_any(low, L.SERVICE_TREATMENT), "treatment").otherwise("general"),
        "language": F.when(trimmed == 0, "unknown")
        .when(safe_div(count_chars(text, CJK), trimmed) > 0.5, "zh").otherwise("en"),
        "intent": F.when(contains_any(low, L.SERVICE_QUESTION), "question").otherwise("statement"),
        "complexity": F.when(size < 5, "simple").when(size < 15, "medium").otherwise("complex"),
        "keywords": F.slice(F.filter(
            words(text), lambda w: ~F.lower(w).isin(*L.SERVICE_STOP_WORDS) & (F.length(w) > 1)
        ), 1, 10),
    })


def suggestions(queries: DataFrame, limit: int = 5) -> DataFrame:
    tails = F.array(*[F.concat(F.col("text"), F.lit(s)) for s in L.SUGGESTION_SUFFIXES[:limit]])
    return queries.select("query_id", F.posexplode(tails).alias("pos", "suggestion"))


# -------------------------------------------------------------- transformation


def expand(text: Column, limit: int = 5) -> Column:
    """Original query, synonym and expansion variants, question variants; distinct, first five."""
    parts = [F.array(text)]
    for table in (L.QUERY_SYNONYMS, L.QUERY_EXPANSIONS):
        for term, options in table.items():
            variants = F.array(*[F.replace(text, F.lit(term), F.lit(o)) for o in options])
            parts.append(F.when(text.contains(term), variants).otherwise(F.array().cast("array<string>")))
    parts.append(question_variants(text))
    return F.slice(F.array_distinct(F.concat(*parts)), 1, limit)


def _filled(patterns, term: Column) -> Column:
    out = []
    for p in patterns:
        head, tail = p.split("{}")
        out.append(F.concat(F.lit(head), term, F.lit(tail)))
    return F.array(*out)


def question_variants(text: Column) -> Column:
    def bare(word):
        return F.regexp_replace(F.replace(text, F.lit(word), F.lit("")), "[？?]", "")

    none = F.array().cast("array<string>")
    return (
        F.when(~contains_any(text, L.QUESTION_MARKS), _filled(L.STATEMENT_VARIANTS, text))
        .when(text.startswith("什么是"), _filled(L.DEFINITION_VARIANTS, bare("什么是")))
        .when(text.contains("如何"), _filled(L.HOWTO_VARIANTS, bare("如何")))
        .otherwise(none)
    )


def rewrite(text: Column, context: Column | None = None) -> Column:
    """Without stop words, with normal terms, completed from the context."""
    out = F.array_join(F.filter(words(text), lambda w: ~w.isin(*L.REWRITE_STOP_WORDS)), " ")
    for old, new in L.REWRITE_TERMS.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    if context is not None:
        out = F.when(context.contains("患者") & ~out.contains("患者"), F.concat(F.lit("患者 "), out)).otherwise(out)
        out = F.when(context.contains("治疗") & ~out.contains("治疗"), F.concat(out, F.lit(" 治疗"))).otherwise(out)
    return out


def query_entities(text: Column) -> dict[str, Column]:
    """Four classes of entities by substring."""
    low = F.lower(text)
    return {
        name: F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, t))
        for name, terms in L.QUERY_ENTITIES.items()
    }
