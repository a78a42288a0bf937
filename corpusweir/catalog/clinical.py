"""Given documents retold with the lexicons' words, and the statements that check work on them.

The lexicons are Chinese, the given texts are not.  Frequent words become terms, abbreviations,
headers and references, French vowels and Spanish letters become Chinese characters, so every
branch of cleaning, standardising and language detection has something to do.  The expression
reads alike in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusweir import lexicon as L
from corpusweir.catalog import sql as S
from corpusweir.catalog.registry import texts
from corpusweir.functions.text import WS

# (given words, what they become)
RETOLD = (
    (" the ", " 心肌梗塞 "), (" of ", " MI "), (" to ", " mi and CT, "), (" for ", " 急性MI "), (" that ", " NT-proBNP "),
    (" it ", " 高血压病 "), (" in ", "心梗"), (" was ", " ａＢ００７ "), (" with ", " 阿司匹林 "), (" this ", " 肺炎 "), (" by ", " 肾移植 "),
    (" der ", " 冠心病 心梗 "), (" die ", " ct "), (" und ", " 高血压 "), (" sch ", "\n作者单位：x\n"), (" ung ", "。。；\n·综 述·\n"),
    ("\nThe ", "\nvol. 3 "), ("\nAnd ", "\n参考文献\n[1] "), ("\nOf ", "\n[2] "), ("\nTo ", "\nReferences\n12. "), ("\nIn ", "\n3. "),
    ("\nIs ", "\n2020-1-02 "), ("\nIt ", "\n中国扩张型心肌病诊断和治疗指南 "), ("\nDie ", "\n心力衰竭诊断标准与规范 "), ("\nDer ", "\n执笔者：y "),
)
ASKED = (
    (" the ", " 高血压病 的 "), (" of ", " 头痛 或 "), (" de ", " 感冒 "), (" and ", " 化疗 和 "), (" to ", " 阿司匹林 "), (" in ", " 患者 在 "),
    (" a ", " 恶性肿瘤 "), (" is ", " 物理治疗 是 "), (" it ", " 咳嗽 "), (" la ", " 胰岛素 "), (" der ", " 糖尿病患者 "), (" for ", " 因为 肺炎 "),
)
VOWELS, LETTERS = "aeiouAEIOU", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
CHARACTERS = "患者的病情稳定无明显不适体征平稳心肺听诊未闻及异常音腹部柔软无压痛反跳痛肠鸣正常神清语利"[: len(LETTERS)].ljust(len(LETTERS), "好")


def _quoted(s: str) -> str:
    return " || ".join("chr(10)" if part == "\n" else f"'{part}'" for part in s.replace("\n", "\0\n\0").split("\0") if part)


def in_other_words(pairs) -> str:
    out = "text"
    for word, term in pairs:
        out = f"replace({out}, {_quoted(word)}, {_quoted(term)})"
    return out


def _retold() -> str:
    out = in_other_words(RETOLD)
    return (f"CASE lang WHEN 'es' THEN translate(text, '{LETTERS}', '{CHARACTERS}') "
            f"WHEN 'fr' THEN translate(text, '{VOWELS}', '{CHARACTERS[:len(VOWELS)]}') ELSE {out} END")


#: ``t0(doc_id, source, text)`` of the SQL.
TEXTS = f"t0 AS (SELECT doc_id, source, {_retold()} AS text FROM documents)"


def clinical(spark, sf):
    """(doc_id, source, text) of every document, retold."""
    return texts(spark, sf).select("doc_id", "source", F.expr(_retold()).alias("text"))


def literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def escaped(s: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in s)


def whole(pattern: str) -> str:
    return rf"(^|[^\p{{L}}\p{{N}}_])(?i:{pattern})($|[^\p{{L}}\p{{N}}_])"


def replaced(name: str, source: str, entries: list[tuple[str, str]], block: int = 20) -> str:
    """CTEs ending in ``name``: whole words of ``source.text`` replaced one entry after the other.

    Neighbouring words share the character between them, so every entry is applied twice.
    """
    ctes, last = [], source
    for n in range(0, len(entries), block):
        out = "text"
        for short, full in entries[n : n + block]:
            for _ in range(2):
                out = rf"regexp_replace({out}, {literal(whole(escaped(short)))}, {literal(chr(92) + '1' + full + chr(92) + '2')}, 'g')"
        mine = name if n + block >= len(entries) else f"{name}_{n}"
        ctes.append(f"{mine} AS MATERIALIZED (SELECT * REPLACE ({out} AS text) FROM {last})")
        last = mine
    return ", ".join(ctes)


def standard_entries() -> list[tuple[str, str]]:
    """What the dictionaries replace, longest first; an entry of a later list replaces an earlier one."""
    merged = dict(L.STANDARD_TERMS) | dict(L.ABBREVIATIONS)
    for same in (L.DRUGS, L.DISEASES, L.PROCEDURES):
        merged |= {x: x for x in same}
    return [e for e in sorted(merged.items(), key=lambda e: -len(e[0])) if e[0] != e[1]]


def without_headers(name: str, source: str) -> str:
    heads = "|".join(L.HEADER_PATTERNS)
    return f"""{name}_l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {source}),
 {name}_s AS (SELECT doc_id, i, {S.strip('raw')} AS line FROM {name}_l),
 {name} AS (SELECT doc_id, coalesce((string_agg(line, chr(10) ORDER BY i)), '') AS text FROM {source} LEFT JOIN
  (SELECT * FROM {name}_s WHERE line <> '' AND NOT regexp_matches(line, '(?i)^({heads})')) USING (doc_id) GROUP BY doc_id)"""


def without_repeats(name: str, source: str) -> str:
    return f"""{name}_l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {source}),
 {name}_k AS (SELECT doc_id, i, {S.strip('raw')} AS line, regexp_replace(lower({S.strip('raw')}), '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS key FROM {name}_l),
 {name} AS (SELECT doc_id, coalesce((string_agg(line, chr(10) ORDER BY i)), '') AS text FROM {source} LEFT JOIN
  (SELECT * FROM {name}_k WHERE line <> '' AND length(key) >= 10 QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY i) = 1) USING (doc_id)
  GROUP BY doc_id)"""


def without_noise(name: str, source: str) -> str:
    """Noise marks, repeated punctuation, page numbers, addresses; full-width forms become ASCII."""
    s = WS[1:-1]
    first = (
        ("书书书+", ""),
        (rf"[^\p{{L}}\p{{N}}_{s}\x{{4e00}}-\x{{9fff}}\x{{3000}}-\x{{303f}}\x{{ff00}}-\x{{ffef}}.,;:!?()\[\]{{}}\"—–\-+*/=<>@#$%^&|\\~`]+", ""),
        (rf"\n{WS}*\n{WS}*\n+", "\n\n"), (r"[ \t]+", " "), (rf"^{WS}+|{WS}+$", ""), (r"(^|[^０-９])０+([０-９])", r"\1\2"),
    )
    second = (
        (r"([。，；：！？])[。，；：！？]+", r"\1"), (r"([.,:;!?])[.,:;!?]+", r"\1"),
        (rf"^{WS}*第?{WS}*\p{{Nd}}+{WS}*页?{WS}*$", ""), (rf"^{WS}*Page{WS}+\p{{Nd}}+{WS}*$", ""), (rf"^{WS}*-{WS}*\p{{Nd}}+{WS}*-{WS}*$", ""),
        (rf"DOI[:：]{WS}*[^\n]+", ""), (rf"ISSN[:：]{WS}*[^\n]+", ""), (rf"doi[:：]{WS}*[^\n]+", ""),
        (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", ""), (rf"https?://[^{s}]+", ""), (rf"www\.[^{s}]+", ""),
        (r"[·•\-=]{3,}", ""), (r"[*]{3,}", ""),
    )

    def steps(text, patterns):
        for pattern, new in patterns:
            text = f"regexp_replace({text}, {literal(pattern)}, {literal(new)}, 'g')"
        return text

    plain = "translate(" * 2 + steps("text", first) + f", '{L.FULL_WIDTH_DIGITS}', '{L.HALF_WIDTH_DIGITS}'), '{L.FULL_WIDTH_LETTERS}', '{L.HALF_WIDTH_LETTERS}')"
    return f"{name}_a AS (SELECT doc_id, {plain} AS text FROM {source}), {name} AS (SELECT doc_id, {steps('text', second)} AS text FROM {name}_a)"


def collapsed(text: str) -> str:
    return S.strip(f"regexp_replace({text}, '{WS}+', ' ', 'g')")
