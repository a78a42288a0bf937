"""Text expressions: Catalyst expressions, but for the character entropy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Whitespace as Python's ``str.split()`` sees it, spelled as code points so that
# every regex dialect reads it the same way.
WS = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
WORD = r"[\p{L}\p{N}_]"
CJK = r"[\x{4e00}-\x{9fff}]"
SENTENCE_END = r"[.!?。！？]"
TOKEN_GAP = r"[^\p{L}\p{N}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``.

    A lambda body is evaluated per element, so whatever it captures is bound
    here first instead of being computed again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are evaluated exactly once.

    The optimizer merges projections and copies expensive expressions into later
    filters; it does not do so across a generator of one row.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


#: The characters of ``WS``.
SPACES = "".join(map(chr, (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    """Whitespace words, as ``str.split()`` yields them."""
    return F.filter(F.split(text, f"{WS}+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits: the index tokenizer."""
    return F.array_remove(F.split(F.lower(text), TOKEN_GAP), "")


def token_line(text: Column) -> Column:
    """The ``tokens`` of a text as one string, a space between two: handed to Arrow at a fraction of a list's cost."""
    return F.btrim(F.regexp_replace(F.lower(text), TOKEN_GAP, " "))


def line_tokens(line: Column) -> Column:
    """The ``tokens`` of a text from its ``token_line``."""
    return F.array_remove(F.split(line, " "), "")


def token_lists(lines: pa.Array) -> pa.ListArray:
    """The tokens of every ``token_line``; no list for one that is empty or null."""
    empty = pc.fill_null(pc.equal(lines, ""), False)
    return pc.split_pattern(pc.replace_with_mask(lines, empty, pa.scalar(None, pa.string())), " ")


def word_runs(text: Column) -> Column:
    r"""Unicode ``\w+`` runs."""
    return F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def has_word(text: Column, pattern: str) -> Column:
    """``pattern`` occurs in ``text`` bounded by non-word characters."""
    return text.rlike(rf"(^|[^\p{{L}}\p{{N}}_])({pattern})($|[^\p{{L}}\p{{N}}_])")


def contains_any(text: Column, needles) -> Column:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | text.contains(needle)
    return hit


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def count_chars(text: Column, char_class: str) -> Column:
    """Characters of a class: the length lost with their runs (one match per run, not per character)."""
    return F.length(text) - F.length(F.regexp_replace(text, f"(?:{char_class})+", ""))


def safe_div(num: Column, den: Column) -> Column:
    """Ratio with 0 where the denominator is 0 (ANSI mode would raise)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / F.nullif(den, F.lit(0)))


def mean_of(values: Column) -> Column:
    """Mean of an array of numbers, 0 for an empty one."""
    return let(values, lambda v: safe_div(
        F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double")), F.size(v)
    ))


def language(text: Column) -> Column:
    """zh / en / mixed by the share of CJK characters; unknown when blank."""
    sizes = F.struct(F.length(strip(text)).alias("total"), count_chars(text, CJK).alias("cjk"))
    return let(sizes, lambda s: let(safe_div(s["cjk"], s["total"]), lambda ratio: (
        F.when(s["total"] == 0, "unknown")
        .when(ratio > 0.7, "zh")
        .when(ratio < 0.1, "en")
        .otherwise("mixed")
    )))


def _bits(texts: pd.Series) -> pd.Series:
    """Shannon entropy of the characters of every text in an Arrow batch."""
    def one(t: str) -> float:
        _, counts = np.unique(np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32), return_counts=True)
        p = counts / counts.sum()
        return float(-(p * np.log2(p)).sum()) + 0.0

    return texts.map(lambda t: one(t) if t else 0.0)


def entropy(text: Column) -> Column:
    """Character entropy in bits, per row and without a shuffle.

    Counting characters has no cheap expression (exploding them shuffles more
    than the text itself), so this is a vectorised function over Arrow batches.
    """
    return F.pandas_udf(_bits, "double")(F.lower(text))


def repetition_ratio(text: Column) -> Column:
    """Share of words that repeat an earlier word; 0 below two words."""
    return let(words(text), lambda w: F.when(F.size(w) < 2, F.lit(0.0)).otherwise(
        F.lit(1.0) - F.size(F.array_distinct(w)) / F.size(w)
    ))


def text_hash(text: Column) -> Column:
    return F.md5(text)


def snippet(text: Column, length: int, suffix: str = "...") -> Column:
    """Leading ``length`` characters, with ``suffix`` when something was cut."""
    return F.when(
        F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit(suffix))
    ).otherwise(text)
