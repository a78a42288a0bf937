"""Secret scan with one combined deterministic automaton.

All rules are compiled, in the driver, into one automaton that reads a text once
from its end and tells at every byte which rules have a match beginning there.
Leftmost non-overlapping matches then follow by walking the beginnings of a rule in
order and taking the longest match of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweir.llm import automaton
from corpusweir.llm.shingling import chunks

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


@dataclass(frozen=True)
class Rule:
    """``head`` followed by a run of bytes of the class ``body``.

    A match is the longest one; it is dropped, but still consumes its text, when the
    run is shorter than ``least``.  ``run`` bytes of the body are needed for a match
    at all; rules without a body have ``body=""``.
    """

    kind: str
    head: str
    body: str
    least: int = 0
    run: int = 1


# The base rules of the scan.
BASE_RULES = (
    Rule("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?", "[A-Za-z0-9+/_.=-]", 8),
    Rule("access", "AKIA", "[A-Z0-9]", 12),
    Rule("hex", "", "[0-9a-f]", 32, 32),
)

#: Published formats of keys and tokens.
MORE_RULES = (
    Rule("pem", r"-----BEGIN (?:(?:RSA|EC|DSA|OPENSSH|PGP|ENCRYPTED) )?PRIVATE KEY(?: BLOCK)?", "[-]", 5),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]", 10),
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", 36),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]", 10),
    Rule("google", "AIza", "[0-9A-Za-z_-]", 35),
)

RULES = BASE_RULES + MORE_RULES


class Scanner:
    """The transition arrays of a list of rules; small enough to travel with the task."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        whole = [r.head + (f"{r.body}{{{r.run},}}" if r.body else "") for r in rules]
        self.starts = automaton.compile_all(whole, backwards=True, anywhere=True)
        self.heads = [automaton.compile_all([r.head]) for r in rules]
        self.bodies = []
        for r in rules:
            inside = np.zeros(256, bool)
            inside[sorted(automaton.byte_set(r.body)) if r.body else []] = True
            self.bodies.append(inside)
        newline = self.starts.table.reshape(-1, self.starts.width)[:, self.starts.byte_class[10]]
        if not (newline == self.starts.start).all():
            raise ValueError("texts are joined by line feeds, which no rule may match")

    def _run_end(self, data: np.ndarray, inside: np.ndarray, at: int) -> int:
        step = 64
        while at < len(data):
            out = np.flatnonzero(~inside[data[at : at + step]])
            if len(out):
                return at + int(out[0])
            at += step
            step *= 2
        return len(data)

    def scan(self, texts: list[bytes]) -> Iterator[list[tuple[int, int, int]]]:
        """Per text, its spans (start, rule, end) in bytes, in order."""
        joined = b"\n".join(texts) + b"\n"
        data = np.frombuffer(joined, np.uint8)
        places, states = automaton.hits(self.starts, data[::-1])
        places, masks = len(data) - 1 - places[::-1], self.starts.matches[states[::-1]]
        spans: list[tuple[int, int, int]] = []
        for k, rule in enumerate(self.rules):
            begins = places[(masks >> k) & 1 == 1]
            i = 0
            while i < len(begins):
                start = int(begins[i])
                head = automaton.longest(self.heads[k], joined, start)
                end = self._run_end(data, self.bodies[k], head) if rule.body else head
                if end - head >= rule.least:
                    spans.append((start, k, end))
                i = int(np.searchsorted(begins, end))
        spans.sort()
        begin, i = 0, 0
        for text in texts:
            mine = []
            while i < len(spans) and spans[i][0] <= begin + len(text):
                start, k, end = spans[i]
                mine.append((start - begin, k, end - begin))
                i += 1
            yield mine
            begin += len(text) + 1


def code_points(text: bytes, places: np.ndarray) -> np.ndarray:
    """Byte offsets as offsets in code points."""
    if text.isascii():
        return places
    leads = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    return np.concatenate(([0], np.cumsum(leads)))[places]


def secret_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """One row per row of ``docs``: its id and ``spans`` (kind, start, end), by start, then rule order.

    Offsets are code points, the end exclusive.  A null text counts as empty and has no
    spans; a null id stays null; repeated rows are scanned each; other columns are not
    read, so their names cannot clash; an empty table gives an empty result.
    """
    scanner = Scanner(rules)
    id_type = docs.schema[id_col].dataType
    names = [r.kind for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            out = []
            for a, b in chunks(texts):
                for text, spans in zip(texts[a:b], scanner.scan(texts[a:b]), strict=True):
                    if spans:
                        starts = code_points(text, np.array([s for s, _, _ in spans]))
                        ends = code_points(text, np.array([e for _, _, e in spans]))
                        spans = [
                            {"kind": names[k], "start": int(s), "end": int(e)}
                            for (_, k, _), s, e in zip(spans, starts, ends, strict=True)
                        ]
                    out.append(spans)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], [id_col, "spans"])

    narrow = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    return narrow.mapInArrow(run, f"{_quoted(id_col)} {id_type.simpleString()}, spans {SPANS}")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def digest(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as text."""

    def listed(of):
        return F.array_join(
            F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    def of_kind(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = [r.kind for r in BASE_RULES]
    return spans.select(
        id_col,
        *[of_kind(k).alias(f"n_{k}") for k in base],
        F.sha2(listed(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


