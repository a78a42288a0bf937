"""Term standardisation against dictionaries.

The dictionaries are a few hundred fixed entries plus an optional custom file, so
they travel as literals of the plan.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweir import lexicon as L


def _same(names) -> dict[str, str]:
    return {n: n for n in names}


@dataclass(frozen=True)
class Dictionary:
    standard_terms: dict[str, str] = field(default_factory=lambda: dict(L.STANDARD_TERMS))
    abbreviations: dict[str, str] = field(default_factory=lambda: dict(L.ABBREVIATIONS))
    synonyms: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(L.SYNONYMS))
    drug_names: dict[str, str] = field(default_factory=lambda: _same(L.DRUGS))
    disease_names: dict[str, str] = field(default_factory=lambda: _same(L.DISEASES))
    procedure_names: dict[str, str] = field(default_factory=lambda: _same(L.PROCEDURES))

    def extended(self, path: str) -> Dictionary:
        """With the entries of a JSON file; synonyms are appended, the rest replaced."""
        with open(path, encoding="utf-8") as f:
            extra = json.load(f)
        synonyms = {k: (*self.synonyms.get(k, ()), *v) for k, v in extra.get("synonyms", {}).items()}
        return Dictionary(
            {**self.standard_terms, **extra.get("standard_terms", {})},
            {**self.abbreviations, **extra.get("abbreviations", {})},
            {**self.synonyms, **synonyms},
            {**self.drug_names, **extra.get("drug_names", {})},
            {**self.disease_names, **extra.get("disease_names", {})},
            {**self.procedure_names, **extra.get("procedure_names", {})},
        )

    def mappings(self) -> list[tuple[str, str]]:
        """All replacements, longest original first."""
        merged = {**self.standard_terms, **self.abbreviations, **self.drug_names,
                  **self.disease_names, **self.procedure_names}
        return sorted(merged.items(), key=lambda e: len(e[0]), reverse=True)


def standardiser(dictionary: Dictionary = Dictionary(), plain: bool = False):
    """Column function replacing every term, longest first, one after the other.

    A replacement can create text a later term matches, so the fold is ordered
    and runs as one Arrow batch function.  Terms are bounded by non-word
    characters; ``plain`` replaces them anywhere, which suits unspaced scripts.
    """
    steps = [
        (a.lower(), re.compile(re.escape(a) if plain else rf"\b{re.escape(a)}\b", re.IGNORECASE), b)
        for a, b in dictionary.mappings() if a != b
    ]

    def fold(text: str | None) -> str | None:
        if not text:
            return text
        low = text.lower()
        for needle, pattern, standard in steps:
            if needle in low:
                text, n = pattern.subn(standard, text)
                low = text.lower() if n else low
        return text

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(fold)

    def apply(text: Column) -> Column:
        blank = F.length(F.trim(text)) == 0
        return F.when(blank, "").otherwise(run(text))

    return apply


def _word(text: Column, term: Column) -> Column:
    """``term`` as a whole word; the pattern is built per dictionary entry."""
    return F.regexp_like(text, F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), term, F.lit(r"\E(?![\p{L}\p{N}_])")))


def _literals(names) -> Column:
    return F.array(*[F.lit(n) for n in names])


def entity_classes(text: Column, d: Dictionary = Dictionary()) -> dict[str, Column]:
    """Dictionary entities per class, distinct, in dictionary order."""
    def inside(names):
        return F.filter(_literals(dict.fromkeys(names)), lambda n: F.contains(text, n))

    short = F.array_compact(F.array(*[
        F.when(F.contains(text, F.lit(a)) & _word(text, F.lit(a)), F.lit(a)) for a in d.abbreviations
    ]))
    return {
        "diseases": inside(d.disease_names.values()), "drugs": inside(d.drug_names.values()),
        "procedures": inside(d.procedure_names.values()), "abbreviations": short,
        "symptoms": F.array().cast("array<string>"),
    }


def variation_table(spark: SparkSession, d: Dictionary = Dictionary()) -> DataFrame:
    """(standard_term, variation): synonyms, reverse mappings and the term itself."""
    pairs = {(s, v) for s, vs in d.synonyms.items() for v in vs}
    for table in (d.standard_terms, d.abbreviations, d.drug_names, d.disease_names, d.procedure_names):
        pairs |= {(standard, original) for original, standard in table.items()}
    pairs |= {(s, s) for s, _ in pairs}
    return spark.createDataFrame(sorted(pairs), "standard_term string, variation string")


def variations(terms: DataFrame, table: DataFrame) -> DataFrame:
    """Distinct variations of every term, the term included."""
    found = terms.join(F.broadcast(table), "standard_term", "left")  # a few hundred fixed entries
    return found.groupBy("standard_term").agg(
        F.array_sort(F.array_distinct(F.concat(
            F.array("standard_term"), F.collect_set("variation")))).alias("variations"))


def validate(text: Column, d: Dictionary = Dictionary()) -> dict[str, Column]:
    """Non-standard terms and unexpanded abbreviations, with suggestions."""
    terms = {a: s for a, s in d.standard_terms.items() if a != s and a.find(s) < 0}
    odd = F.array_compact(F.array(*[
        F.when(F.contains(text, F.lit(a)) & ~F.contains(text, F.lit(s)), F.struct(F.lit(a).alias("a"), F.lit(s).alias("s")))
        for a, s in terms.items()
    ]))
    short = F.array_compact(F.array(*[
        F.when(F.contains(text, F.lit(a)) & _word(text, F.lit(a)) & ~F.contains(text, F.lit(s)),
               F.struct(F.lit(a).alias("a"), F.lit(s).alias("s")))
        for a, s in d.abbreviations.items()
    ]))
    return {
        "non_standard_terms": F.transform(odd, lambda p: p["a"]),
        "missing_standardization": F.transform(short, lambda p: p["a"]),
        "suggestions": F.concat(
            F.transform(odd, lambda p: F.format_string("Replace '%s' with '%s'", p["a"], p["s"])),
            F.transform(short, lambda p: F.format_string("Consider expanding '%s' to '%s'", p["a"], p["s"]))),
    }
