"""Noise removal, headers and footers, repeated lines, structure of a text.

Line-wise steps run before whitespace is collapsed.  ``strict=True`` keeps the
other order, in which the later steps see the whole text as one line.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweir import lexicon as L
from corpusweir.functions.text import WS, computed, let, strip, word_runs

_W = r"\p{L}\p{N}_"
# Inside a class: white space beyond ASCII counts as well.
_S = WS[1:-1]
_EDGE = rf"(?<![{_W}])"
_EDGE_END = rf"(?![{_W}])"

# Noise patterns in their order; $1 keeps a run's first mark.  The
# third entry is a string every match contains: texts without it are not searched.
NOISE_BEFORE_DIGITS = (
    (r"书书书+", "", "书书"),
    (rf"[^{_W}{_S}\x{{4e00}}-\x{{9fff}}\x{{3000}}-\x{{303f}}\x{{ff00}}-\x{{ffef}}.,;:!?()\[\]{{}}\"—–\-+*/=<>@#$%^&|\\~`]+", "", None),
    (rf"\n{WS}*\n{WS}*\n+", "\n\n", "\n"),
    (r"[ \t]+", " ", None),
    (rf"^{WS}+|{WS}+$", "", None),
)
NOISE_AFTER_DIGITS = (
    (r"([。，；：！？])[。，；：！？]+", "$1", None),
    (r"([.,:;!?])[.,:;!?]+", "$1", None),
    (rf"^{WS}*第?{WS}*\p{{Nd}}+{WS}*页?{WS}*$", "", None),
    (rf"^{WS}*Page{WS}+\p{{Nd}}+{WS}*$", "", "Page"),
    (rf"^{WS}*-{WS}*\p{{Nd}}+{WS}*-{WS}*$", "", "-"),
    (rf"DOI[:：]{WS}*[^\n]+", "", "DOI"),
    (rf"ISSN[:：]{WS}*[^\n]+", "", "ISSN"),
    (rf"doi[:：]{WS}*[^\n]+", "", "doi"),
    (rf"{_EDGE}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}{_EDGE_END}", "", "@"),
    (rf"https?://[^{_S}]+", "", "http"),
    (rf"www\.[^{_S}]+", "", "www."),
    (r"[·•\-=]{3,}", "", None),
    (r"[*]{3,}", "", "***"),
)


def _without(text: Column, patterns) -> Column:
    def step(pattern, replacement, needle):
        def run(t):
            after = F.regexp_replace(t, pattern, replacement)
            return F.when(F.contains(t, F.lit(needle)), after).otherwise(t) if needle else after

        return run

    for entry in patterns:
        text = let(text, step(*entry))
    return text


def remove_noise(text: Column) -> Column:
    """The noise patterns, full-width letters and digits made ASCII; line breaks stay."""
    # A run of full-width digits reads as a number: its leading zeros go.
    def ascii_forms(t):
        plain = F.translate(F.regexp_replace(t, r"(?<![０-９])０+(?=[０-９])", ""), L.FULL_WIDTH_DIGITS, L.HALF_WIDTH_DIGITS)
        return F.when(
            t.rlike("[０-９Ａ-Ｚａ-ｚ]"), F.translate(plain, L.FULL_WIDTH_LETTERS, L.HALF_WIDTH_LETTERS)
        ).otherwise(t)

    return _without(let(_without(text, NOISE_BEFORE_DIGITS), ascii_forms), NOISE_AFTER_DIGITS)


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"{WS}+", " "))


def clean_basic(text: Column) -> Column:
    return F.when(strip(text) == "", "").otherwise(collapse(remove_noise(text)))


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda line: line != "")


def drop_headers(text: Column, patterns=L.HEADER_PATTERNS) -> Column:
    """Lines that start like a header or footer go."""
    start = "(?i)^(" + "|".join(patterns) + ")"
    return F.array_join(F.filter(_lines(text), lambda line: ~line.rlike(start)), "\n")


def expand_abbreviations(text: Column, table: dict[str, str] = L.CLEANER_ABBREVIATIONS,
                         custom: dict[str, str] | None = None) -> Column:
    """Whole-word, case-insensitive replacement in table order.

    A whole word is a word run, so the runs of the text tell which of the
    replacements have anything to do; the others do not look at the text.
    """
    steps = {a: f for a, f in {**table, **(custom or {})}.items() if a != f}
    names = F.array(*[F.lit(a.lower()) for a in steps])

    def step(present, short, full):
        pattern = rf"(?iu){_EDGE}\Q{short}\E{_EDGE_END}"
        one_run = re.fullmatch(r"\w+", short) is not None

        def run(t):
            after = F.regexp_replace(t, pattern, full)
            return F.when(F.array_contains(present, short.lower()), after).otherwise(t) if one_run else after

        return run

    def replaced(present):
        out = text
        for short, full in steps.items():
            out = let(out, step(present, short, full))
        return out

    return let(F.array_intersect(word_runs(F.lower(text)), names), replaced)


def line_key(line: Column) -> Column:
    return F.regexp_replace(F.lower(line), rf"[^{_W}]", "")


def drop_repeated_lines(text: Column, min_key: int = 10) -> Column:
    """First of every line (by its word characters); shorter lines go.

    Runs inside the row: the first position of each key is found in the key
    array itself, so documents are neither exploded nor shuffled.
    """
    keyed = F.filter(
        F.transform(_lines(text), lambda x: F.struct(line_key(x).alias("k"), x.alias("line"))),
        lambda s: F.length(s["k"]) >= min_key,
    )
    placed = F.transform(keyed, lambda s, i: F.struct(s["k"].alias("k"), i.alias("i"), s["line"].alias("line")))

    def firsts(in_order):
        # Sorted by key, equal lines are neighbours; the first of each survives.
        marked = F.transform(in_order, lambda s, j: F.struct(
            s["i"].alias("i"), s["line"].alias("line"),
            ((j == 0) | (F.get(in_order, j - 1)["k"] != s["k"])).alias("first"),
        ))
        return F.array_sort(F.filter(marked, lambda s: s["first"]))

    return F.array_join(F.transform(let(F.array_sort(placed), firsts), lambda s: s["line"]), "\n")


def clean_steps(df: DataFrame, text: str = "text", out: str = "cleaned", strict: bool = False,
                custom: dict[str, str] | None = None) -> DataFrame:
    """Noise, headers, abbreviations, repeated lines, final clean-up.

    Every step is evaluated once, whatever is filtered or selected afterwards.
    """
    first = clean_basic(F.col(text)) if strict else remove_noise(F.col(text))
    out_df = computed(df, {"_c1": first})
    out_df = computed(out_df, {"_c2": drop_headers(F.col("_c1"))})
    out_df = computed(out_df, {"_c3": expand_abbreviations(F.col("_c2"), custom=custom)})
    out_df = computed(out_df, {"_c4": drop_repeated_lines(F.col("_c3"))})
    return computed(out_df, {out: clean_basic(F.col("_c4"))}).drop("_c1", "_c2", "_c3", "_c4")


# -------------------------------------------------------------------- structure

TITLE_RE = r"^[一二三四五六七八九十]+[、．]|^\p{Nd}+[\.、]\s*[^0-9]"
LIST_RE = r"^[•·\-\*]\s+|^\p{Nd}+[\.）\)]\s+|^[（\(]\p{Nd}+[）\)]\s+"
REFERENCE_RE = r"^\[\p{Nd}+\]|^\p{Nd}+\.\s+[A-Z]"


def line_kind(line: Column) -> Column:
    upper = (line == F.upper(line)) & (F.lower(line) != F.upper(line))
    return (
        F.when(line == "", "blank")
        .when((F.length(line) < 100) & (upper | line.rlike(TITLE_RE)), "titles")
        .when(line.rlike(LIST_RE), "lists")
        .when(line.rlike(REFERENCE_RE) | line.contains("参考文献"), "references")
        .otherwise("paragraphs")
    )


def structure(text: Column) -> Column:
    """Map from kind to its blocks; neighbouring paragraph lines form one block.

    A paragraph line after another one is glued to it through a marker, inside
    the row.
    """
    glue, sep = "\x01", "\x02"
    typed = F.transform(
        F.transform(F.split(text, "\n"), strip), lambda x: F.struct(line_kind(x).alias("k"), x.alias("x"))
    )

    def of(rows, kind):
        return F.transform(F.filter(rows, lambda s: s["k"] == kind), lambda s: s["x"])

    def blocks(rows):
        def lead(s, i):
            follows = (i > 0) & (F.get(rows, i - 1)["k"] == "paragraphs")
            return F.when(s["k"] == "paragraphs", F.concat(F.when(follows, glue).otherwise(sep), s["x"])).otherwise("")

        joined = F.split(F.array_join(F.transform(rows, lead), ""), sep)
        return F.transform(F.filter(joined, lambda b: b != ""), lambda b: F.replace(b, F.lit(glue), F.lit(" ")))

    return let(typed, lambda rows: F.create_map(
        F.lit("titles"), of(rows, "titles"), F.lit("lists"), of(rows, "lists"),
        F.lit("references"), of(rows, "references"), F.lit("paragraphs"), blocks(rows),
    ))


def references(text: Column, min_length: int = 10) -> Column:
    """Entries of the reference section as (reference_id, reference_text)."""
    section = F.coalesce(
        F.nullif(F.regexp_extract(text, r"(?is)(references|bibliography|参考文献).*", 0), F.lit("")),
        F.nullif(F.regexp_extract(text, r"(?is)(参考资料|引用文献|文献引用).*", 0), F.lit("")),
    )
    bracket = F.regexp_extract_all(section, F.lit(r"(?s)\[\d+\].*?(?=\[\d+\]|\z)"), F.lit(0))
    dotted = F.regexp_extract_all(section, F.lit(r"(?s)\d+\.\s+.*?(?=\d+\.\s+|\z)"), F.lit(0))
    entries = F.when(F.size(bracket) > 0, bracket).otherwise(dotted)
    kept = F.filter(F.transform(entries, strip), lambda e: F.length(e) > min_length)
    return F.coalesce(
        F.transform(kept, lambda e: F.struct(
            F.regexp_extract(e, r"[\[\(]?(\d+)[\]\)]?", 1).alias("reference_id"), e.alias("reference_text"))),
        F.array().cast("array<struct<reference_id:string,reference_text:string>>"),
    )


# Lines that are no title, and words that make a line one.  Digits, white
# space and case are those of Unicode.
NOT_A_TITLE = (
    r"^\d+$", r"^第\d+页", r"^Page\s+\d+", r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}", r"^DOI[:：]", r"^ISSN[:：]",
    r"^[·•\-=]{3,}", r"^作者[:：]", r"^Author[:：]", r"^通信作者[:：]", r"^Corresponding\s+Author",
    r"^执笔者[:：]", r"^E[-‐]?mail[:：]", r"^ＤＯＩ[:：]", r"^１０\.", r"cma\.j\.issn",
    r"^·标\s*准\s*与\s*规\s*范\s*·", r"^４\s*２\s*１\s*－\s*４\s*３\s*４\s*Ｊ\s*ｏ\s*ｕ\s*ｒ\s*ｎ\s*ａ\s*ｌ",
    r"临床心血管病杂志", r"^Ｃ\s*ｌ\s*ｉ\s*ｎ\s*ｉ\s*ｃ\s*ａ\s*ｌ", r"^Ｃ\s*ａ\s*ｒ\s*ｄ\s*ｉ\s*ｏ\s*ｌ\s*ｏ\s*ｇ\s*ｙ",
    r"^[Ａ-Ｚａ-ｚ\s]+$", r"^书书书$", r"^[２０１８３４（）：]+$", r"^·指南与共识·$", r"^＊$", r"^基金项目[:：]",
)
NOT_A_CJK_TITLE = (
    r"^·标\s*准\s*与\s*规\s*范\s*·", r"^执笔者[:：]", r"^通信作者[:：]", r"^中国医学科学院", r"^武汉亚洲心脏病医院",
    r"Ｅ[-‐]?ｍａｉｌ[:：]", r"^ＤＯＩ[:：]", r"^书书书", r"^２\s*０\s*１\s*８", r"^临床心血管病杂志", r"临床心血管病杂志",
    r"^Ｊ\s*ｏ\s*ｕ\s*ｒ\s*ｎ\s*ａ\s*ｌ", r"^Ｃ\s*ｌ\s*ｉ\s*ｎ\s*ｉ\s*ｃ\s*ａ\s*ｌ",
    r"^Ｃ\s*ａ\s*ｒ\s*ｄ\s*ｉ\s*ｏ\s*ｌ\s*ｏ\s*ｇ\s*ｙ", r"^·\s*指南与共识\s*·", r"^中华医学会心血管病学分会",
    r"^中国心肌炎心肌病协作组", r"^基金项目[:：]", r"^国家十二五支撑计划", r"^[０-９\s]{10,}",
    r"^[４２１－４３４\s]*Ｊ\s*ｏ\s*ｕ\s*ｒ\s*ｎ\s*ａ\s*ｌ", r"^ｏ\s*ｆ$", r"^（\s*Ｃ\s*ｈ\s*ｉ\s*ｎ\s*ａ\s*）", r"^[（）\s]*$",
    r"^４\s*２\s*１\s*－\s*４\s*３\s*４\s*Ｊ\s*ｏ\s*ｕ\s*ｒ\s*ｎ\s*ａ\s*ｌ",
)
TITLE_WORDS = r"(指南|规范|标准|诊断|治疗)"
KNOWN_TITLE = "中国扩张型心肌病诊断和治疗指南"


def title(text: Column, fallback: Column) -> Column:
    """Heaviest candidate among the first lines, else ``fallback``.

    A line weighs its length; a CJK line gains for guideline words, for one known
    title and for standing alone.  The first of equal candidates wins.
    """
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 20), strip)
    general = F.transform(
        F.filter(lines, lambda x: F.length(x).between(10, 100)
                 & ((F.length(x) >= 20) | ~F.contains(x, F.lit("·")))
                 & ~x.rlike("(?iU)" + "|".join(NOT_A_TITLE))),
        lambda x: F.struct(F.length(x).alias("w"), x.alias("x")),
    )
    cjk = F.transform(
        F.filter(F.slice(lines, 1, 15), lambda x: F.length(x).between(8, 80)
                 & x.rlike(r"[\x{4e00}-\x{9fff}]") & ~x.rlike("(?U)" + "|".join(NOT_A_CJK_TITLE))),
        lambda x: F.struct((
            F.length(x) + F.when(F.contains(x, F.lit(KNOWN_TITLE)), 200).when(x.rlike(TITLE_WORDS), 100).otherwise(0)
            + F.when((F.length(x) >= 15) & ~x.rlike("[，。；：]"), 30).otherwise(0)
        ).alias("w"), x.alias("x")),
    )
    listed = F.concat(general, cjk)
    ranked = F.array_sort(F.transform(listed, lambda s, i: F.struct((-s["w"]).alias("w"), i.alias("i"), s["x"].alias("x"))))
    best = F.get(ranked, F.lit(0))["x"]
    tidy = F.regexp_replace(F.regexp_replace(best, r"(?U)^[·•\-\s]+|[·•\-\s]+$", ""), f"{WS}+", " ")
    return F.when(F.length(tidy) >= 10, tidy).otherwise(fallback)
