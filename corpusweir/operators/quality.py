"""Text, summary and keyword quality.

Every score is a Catalyst expression over one row; a corpus of any size is
scored by a single scan without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweir import lexicon as L
from corpusweir.functions.text import (
    CJK, SENTENCE_END, WS, computed, contains_any, count_chars, count_matches, entropy, let, mean_of, repetition_ratio, safe_div, strip,
    tokens, words,
)


@dataclass(frozen=True)
class Gate:
    """Limits of the quality gate (fixed values as defaults)."""

    min_length: int = 50
    max_length: int = 8000
    min_words: int = 10
    max_repetition: float = 0.7
    min_entropy: float = 2.0
    min_relevance: float = 0.1
    min_overall: float = 0.5


def _sum(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


# ----------------------------------------------------------------- text quality


def length_score(n: Column, gate: Gate = Gate()) -> Column:
    over = F.greatest(F.lit(0.0), 1.0 - (n - gate.max_length) / gate.max_length)
    return (
        F.when(n < gate.min_length, 0.0)
        .when(n > gate.max_length, over)
        .when(n < 200, n / 200)
        .when(n <= 2000, 1.0)
        .otherwise(F.greatest(F.lit(0.5), 1.0 - (n - 2000) / 6000))
    )


def word_count_score(n: Column, gate: Gate = Gate()) -> Column:
    return (
        F.when(n < gate.min_words, 0.0)
        .when(n < 50, n / 50)
        .when(n <= 500, 1.0)
        .otherwise(F.greatest(F.lit(0.5), 1.0 - (n - 500) / 1000))
    )


def repetition_score(ratio: Column, gate: Gate = Gate()) -> Column:
    return F.when(ratio > gate.max_repetition, 0.0).otherwise(1.0 - ratio / gate.max_repetition)


def entropy_score(bits: Column, gate: Gate = Gate()) -> Column:
    return F.when(bits < gate.min_entropy, 0.0).when(bits < 4.0, bits / 4.0).otherwise(1.0)


def relevance(text: Column, groups=L.RELEVANCE_GROUPS) -> Column:
    """Lexicon matches per word, tenfold, at most 1; a term in two groups counts twice."""
    low = F.lower(text)
    matches = _sum([count_matches(low, "|".join(terms)) for terms in groups.values()])
    return F.least(F.lit(1.0), safe_div(matches, F.size(words(text))) * 10)


def relevance_score(value: Column, gate: Gate = Gate()) -> Column:
    return F.when(value < gate.min_relevance, 0.0).otherwise(F.least(F.lit(1.0), value / 0.5))


def language_score(text: Column) -> Column:
    n = F.length(text)
    punct = safe_div(count_chars(text, rf"[^\p{{L}}\p{{N}}_\x{{09}}-\x{{0D}}\x{{1C}}-\x{{20}}\x{{85}}\x{{A0}}]"), n)
    blank = safe_div(count_chars(text, WS), n)
    cjk, latin = count_chars(text, CJK), count_chars(text, "[a-zA-Z]")
    share = safe_div(cjk, cjk + latin)
    return F.greatest(
        F.lit(0.0),
        1.0
        - F.when(punct > 0.3, 0.3).otherwise(0.0)
        - F.when(blank > 0.5, 0.2).otherwise(0.0)
        - F.when((share > 0.1) & (share < 0.9), 0.1).otherwise(0.0),
    )


def structure_score(text: Column) -> Column:
    def mean_length(parts):
        return mean_of(F.transform(parts, lambda s: F.length(strip(s))))

    def outside(pattern, is_odd):
        return let(F.split(text, pattern), lambda parts: (F.size(parts) > 1) & let(mean_length(parts), is_odd))

    odd = outside(SENTENCE_END, lambda m: (m < 10) | (m > 200))
    short = outside("\n\n", lambda m: m < 50)
    broken = count_chars(text, "\n") > F.length(text) / 50
    return F.greatest(
        F.lit(0.0),
        1.0 - F.when(odd, 0.2).otherwise(0.0) - F.when(short, 0.1).otherwise(0.0)
        - F.when(broken, 0.2).otherwise(0.0),
    )


SCORES = ("length_score", "word_count_score", "repetition_score", "entropy_score", "relevance_score",
          "language_score", "structure_score")


def assess(df: DataFrame, text: str = "text", gate: Gate = Gate(), groups=L.RELEVANCE_GROUPS,
           word_split=words) -> DataFrame:
    """Measures, their seven scores, the mean of the scores and the gate's verdict."""
    t = F.col(text)
    out = computed(df, {
        "length": F.length(t), "word_count": F.size(word_split(t)), "repetition_ratio": repetition_ratio(t),
        "entropy": entropy(t), "relevance": relevance(t, groups),
        "language_score": language_score(t), "structure_score": structure_score(t),
    })
    out = out.withColumns({
        "length_score": length_score(F.col("length"), gate),
        "word_count_score": word_count_score(F.col("word_count"), gate),
        "repetition_score": repetition_score(F.col("repetition_ratio"), gate),
        "entropy_score": entropy_score(F.col("entropy"), gate),
        "relevance_score": relevance_score(F.col("relevance"), gate),
    })
    out = out.withColumn("overall_score", _sum([F.col(s) for s in SCORES]) / len(SCORES))
    return out.withColumn("passes", passes(gate))


def passes(gate: Gate = Gate()) -> Column:
    return (
        F.col("length").between(gate.min_length, gate.max_length)
        & (F.col("word_count") >= gate.min_words)
        & (F.col("repetition_ratio") <= gate.max_repetition)
        & (F.col("entropy") >= gate.min_entropy)
        & (F.col("relevance") >= gate.min_relevance)
        & (F.col("overall_score") >= gate.min_overall)
    )


def filter_chunks(df: DataFrame, text: str = "text", gate: Gate = Gate(), groups=L.RELEVANCE_GROUPS):
    return assess(df, text, gate, groups).filter("passes")


# -------------------------------------------------------------- content analysis


def content_type(text: Column) -> Column:
    low = F.lower(text)
    out = F.when(F.lit(False), "")
    for name, terms in L.CONTENT_TYPES:
        out = out.when(contains_any(low, terms), name)
    return (
        out.when(text.rlike("<TABLE>.*?</TABLE>"), "table_content")
        .when(text.rlike("<LIST>.*?</LIST>"), "list_content").otherwise("general_text")
    )


def content_analysis(text: Column) -> dict[str, Column]:
    cjk, latin = count_chars(text, CJK), count_chars(text, "[a-zA-Z]")
    marks = {k: count_matches(text, f"<{k.upper()}>.*?</{k.upper()}>")
             for k in ("header", "table", "list", "section")}
    return {
        "char_count": F.length(text), "word_count": F.size(words(text)),
        "sentence_count": F.size(F.split(text, SENTENCE_END)),
        "paragraph_count": F.size(F.split(text, "\n\n")),
        "chinese_ratio": safe_div(cjk, cjk + latin), "english_ratio": safe_div(latin, cjk + latin),
        "primary_language": F.when(cjk + latin == 0, "unknown").when(cjk > latin, "chinese").otherwise("english"),
        "content_type": content_type(text),
        **{f"{k}_count": c for k, c in marks.items()},
        **{f"has_{k}s": c > 0 for k, c in marks.items()},
        "structure_complexity": F.least(F.lit(1.0), _sum(list(marks.values())) / 5.0),
    }


# ------------------------------------------------------------ summaries, keywords


def level(score: Column) -> Column:
    """Quality band; an unknown score counts as fair."""
    return (
        F.when(score.isNull(), "fair").when(score >= 0.8, "excellent").when(score >= 0.6, "good")
        .when(score >= 0.4, "fair").otherwise("poor")
    )


def compression_ratio(original: Column, summary: Column) -> Column:
    return safe_div(F.length(summary), F.length(original))


def _in_terms(terms) -> object:
    return lambda w: w.isin(*terms)


def information_density(text: Column, terms=L.EVALUATOR_TERMS, tokenizer=tokens) -> Column:
    content = F.filter(tokenizer(text), lambda w: ~w.isin(*L.EVALUATOR_STOP_WORDS) & (F.length(w) > 1))

    def density(c):
        variety = safe_div(F.size(F.array_distinct(c)), F.size(c))
        known = safe_div(F.size(F.filter(c, _in_terms(terms))), F.size(c))
        return F.least(variety * 0.7 + known * 0.3, F.lit(1.0))

    return let(content, density)


def readability(text: Column) -> Column:
    sentences = F.filter(F.transform(F.split(text, "[。！？；]"), strip), lambda s: s != "")

    def judged(parts):
        n = F.size(parts)

        def with_mean(mean):
            by_length = (
                F.when(mean < 15, mean / 15).when(mean <= 30, 1.0)
                .otherwise(F.greatest(F.lit(0.3), 30 / F.nullif(mean, F.lit(0.0))))
            )
            by_count = (
                F.when(n < 2, n / 2).when(n <= 8, 1.0)
                .otherwise(F.greatest(F.lit(0.3), 8 / F.nullif(n, F.lit(0))))
            )
            return F.least(by_length * 0.6 + by_count * 0.4, F.lit(1.0))

        return F.when(n == 0, 0.0).otherwise(let(mean_of(F.transform(parts, F.length)), with_mean))

    return let(sentences, judged)


def term_relevance(text: Column, terms=L.EVALUATOR_TERMS, tokenizer=tokens) -> Column:
    content = F.filter(tokenizer(F.lower(text)), lambda w: F.length(w) > 1)
    return let(content, lambda c: F.least(
        safe_div(F.size(F.filter(c, _in_terms(terms))), F.size(c)) * 3, F.lit(1.0)
    ))


def overlap(a: Column, b: Column, tokenizer=tokens) -> Column:
    """Jaccard of the word sets without stop words; 0 when both are empty."""
    def kept(t):
        return F.filter(F.array_distinct(tokenizer(F.lower(t))), lambda w: ~w.isin(*L.EVALUATOR_STOP_WORDS))

    def share(s):
        inter = F.size(F.array_intersect(s["a"], s["b"]))
        return let(F.struct(inter.alias("i"), (F.size(s["a"]) + F.size(s["b"])).alias("n")),
                   lambda c: safe_div(c["i"], c["n"] - c["i"]))

    return let(F.struct(kept(a).alias("a"), kept(b).alias("b")), share)


def fit_range(n: Column, low: int, high: int) -> Column:
    """1 inside the range, proportional below, falling to 0.3 above."""
    return (
        F.when(n < low, n / low).when(n <= high, 1.0)
        .otherwise(F.greatest(F.lit(0.3), F.lit(float(high)) / F.nullif(n, F.lit(0))))
    )


def summary_quality(df: DataFrame, original: str = "text", summary: str = "summary", bonus: float = 0.1,
                    terms=L.EVALUATOR_TERMS, tokenizer=tokens) -> DataFrame:
    """Component scores, overall score and level; a missing side scores 0."""
    o, s = F.col(original), F.col(summary)
    out = computed(df, {
        "length_score": fit_range(F.length(s), 20, 500),
        "coverage_score": overlap(o, s, tokenizer), "readability_score": readability(s),
        "medical_relevance_score": term_relevance(s, terms, tokenizer),
        "compression_ratio": compression_ratio(o, s),
        "info_density": information_density(s, terms, tokenizer),
    })
    out = out.withColumn("coherence_score", F.col("readability_score"))
    base = (
        F.col("length_score") * 0.15 + F.col("coherence_score") * 0.20 + F.col("coverage_score") * 0.25
        + F.col("readability_score") * 0.15 + F.col("medical_relevance_score") * 0.15
        + F.col("info_density") * 0.10
    )
    extra = F.when(F.col("medical_relevance_score") > 0.3, bonus).otherwise(0.0)
    missing = (F.coalesce(F.length(o), F.lit(0)) == 0) | (F.coalesce(F.length(s), F.lit(0)) == 0)
    out = out.withColumn("overall_score", F.when(missing, 0.0).otherwise(F.least(base + extra, F.lit(1.0))))
    return out.withColumn("quality_level", level(F.col("overall_score")))


def keyword_quality(df: DataFrame, original: str = "text", keywords: str = "keywords",
                    scores: str | None = None, bonus: float = 0.1, terms=L.EVALUATOR_TERMS,
                    tokenizer=tokens) -> DataFrame:
    o, k = F.col(original), F.col(keywords)
    n = F.size(k)

    def variance(lengths):
        return let(mean_of(lengths), lambda m: mean_of(F.transform(lengths, lambda x: (x - m) * (x - m))))

    # Only keywords that repeat make the two counts differ, so they are counted one by one.
    known = let(
        F.array_intersect(F.transform(k, F.lower), tokenizer(F.lower(o))),
        lambda found: F.size(F.filter(k, lambda w: F.array_contains(found, F.lower(w)))),
    )
    out = computed(df, {
        "count_score": fit_range(n, 3, 15),
        "relevance_score": safe_div(known, n),
        "diversity_score": safe_div(F.size(F.array_distinct(k)), n) * 0.7
        + F.least(let(F.transform(k, F.length), variance) / 10, F.lit(1.0)) * 0.3,
        "coverage_score": overlap(o, F.array_join(k, " "), tokenizer),
        "medical_specificity_score": safe_div(F.size(F.filter(k, _in_terms(terms))), n),
        "average_keyword_score": mean_of(F.col(scores)) if scores else F.lit(1.0),
    })
    base = (
        F.col("count_score") * 0.15 + F.col("relevance_score") * 0.25 + F.col("diversity_score") * 0.20
        + F.col("coverage_score") * 0.20 + F.col("medical_specificity_score") * 0.10
        + F.col("average_keyword_score") * 0.10
    )
    extra = F.when(F.col("medical_specificity_score") > 0.3, bonus).otherwise(0.0)
    missing = (F.coalesce(F.length(o), F.lit(0)) == 0) | (F.coalesce(n, F.lit(0)) <= 0)
    out = out.withColumn("overall_score", F.when(missing, 0.0).otherwise(F.least(base + extra, F.lit(1.0))))
    return out.withColumn("quality_level", level(F.col("overall_score")))


# Shares of the optional sub-scores.
SUMMARY_SHARES = {"rouge_l": 0.3, "semantic_similarity": 0.25, "coherence_score": 0.25, "coverage_score": 0.2}
KEYWORD_SHARES = {"relevance": 0.3, "coverage": 0.25, "diversity": 0.2, "medical_accuracy": 0.25}


def present_mean(shares: dict[str, float]) -> Column:
    """Weighted mean over the sub-scores that are present; 0 without any."""
    num = _sum([F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in shares.items()])
    den = _sum([F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in shares.items()])
    return F.when(den > 0, num / F.nullif(den, F.lit(0.0))).otherwise(0.0)
