"""Text to chunk rows.

Fixed windows are Catalyst expressions.  The greedy splitters depend on what was
cut before, so they run as small functions on one document inside an Arrow
``pandas_udf``; documents never leave their partition, so no chunker shuffles.
"""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweir.functions.text import strip

# Separators by priority.
SEPARATORS = (
    "\n##SECTION_START_", "\n\n", ".\n\n", "。\n", ".\n", "。\n", "、\n", "：\n", ":\n\n",
    "，\n", ",\n\n", " ", "\t",
)
HYBRID_SEPARATORS = ("\n##SECTION_START_", "\n\n", "。\n\n", ".\n\n", "。\n", ".\n")
SENTENCE_ENDS = ".!?。！？"
PARENT_SIZE, PARENT_OVERLAP = 1024, 200
CHILD_SIZE, CHILD_OVERLAP = 256, 0


def chunk_id(document_id: Column, *parts: Column) -> Column:
    """Repeatable id from the position (runs give the same ids)."""
    return F.concat_ws("-", document_id.cast("string"), *[p.cast("string") for p in parts])


def windows(text: Column, size: int) -> Column:
    """Array of (index, content) cut every ``size`` characters, in one pass over the text."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.transform(cut, lambda content, i: F.struct(i.alias("index"), content.alias("content")))


def fixed_parents(docs: DataFrame, size: int = PARENT_SIZE) -> DataFrame:
    rows = docs.select("doc_id", F.explode(windows(F.col("text"), size)).alias("w"))
    return rows.select(
        chunk_id(F.col("doc_id"), F.col("w.index")).alias("parent_id"),
        "doc_id", F.col("w.index").cast("long").alias("parent_index"), "w.content",
    )


def fixed_children(parents: DataFrame, size: int = CHILD_SIZE) -> DataFrame:
    """Children keep their parent's other columns (summary, keywords)."""
    keep = [c for c in parents.columns if c not in ("content", "doc_id", "parent_id")]
    rows = parents.select(
        "doc_id", "parent_id", *keep, F.explode(windows(F.col("content"), size)).alias("w")
    )
    return rows.select(
        chunk_id(F.col("parent_id"), F.col("w.index")).alias("chunk_id"),
        "doc_id", "parent_id", *keep, F.col("w.index").cast("long").alias("child_index"), "w.content",
    )


# ------------------------------------------------------- splitters of one text


def pieces(text: str, size: int, separators=SEPARATORS) -> list[str]:
    """Break at the separators by priority; a separator is a piece of its own."""
    todo, out = [(text, 0)], []
    while todo:
        part, level = todo.pop()
        while level < len(separators) and separators[level] not in part:
            level += 1
        if level == len(separators):
            out.append(part)
            continue
        sep = separators[level]
        inner: list[tuple[str, int]] = []
        for n, bit in enumerate(part.split(sep)):
            if n:
                inner.append((sep, len(separators)))
            inner.append((bit, level + 1 if len(bit) > size else len(separators)))
        todo.extend(reversed(inner))
    return out


def last_break(breaks: np.ndarray, limit: int) -> int:
    """Index of the last of the ascending ``breaks`` that is not above ``limit``; -1 if all are."""
    return int(np.searchsorted(breaks, limit, "right")) - 1


def pack(text: str, size: int, overlap: int) -> list[str]:
    """As many whole pieces as fit ``size``, at least one, in each chunk.

    A chunk begins with the last ``overlap`` characters of a longer one before it, which
    count.  Chunks are stretches of the text, so one search in the pieces' ends finds
    where each of them stops.
    """
    if len(text) <= size:
        return [text]
    ends = np.cumsum([len(piece) for piece in pieces(text, size)])
    spans, begin, piece = [], 0, 0
    while piece < len(ends):
        last = max(piece, last_break(ends, begin + size))
        stop = int(ends[last])
        spans.append((begin, stop))
        begin = stop - overlap if 0 < overlap < stop - begin else stop
        piece = last + 1
    return stripped(text, spans)


def stripped(text: str, spans: list[tuple[int, int]]) -> list[str]:
    """The stretches of the text without outer white space; blank ones go."""
    return [c for c in (text[i:j].strip() for i, j in spans) if c]


def cut_recursive(text: str, size: int = 1000, overlap: int = 200, min_size: int = 100,
                  separators=HYBRID_SEPARATORS) -> list[str]:
    """Cut at the last occurrence of the best separator near ``size``.

    A cut that would not move past the overlap goes on without one, so the loop
    always advances.
    """
    chunks, start = [], 0
    while len(text) - start > size:
        window = text[start:start + size + overlap]
        cut = size
        for sep in separators:
            at = window.rfind(sep)
            if at >= min_size:
                cut = at + len(sep)
                break
        chunks.append(text[start:start + cut].strip())
        start += cut - overlap if cut > overlap else cut
    chunks.append(text[start:].strip())
    return [c for c in chunks if c]


def join_overlapping(left: str, right: str, longest: int) -> str:
    """Concatenate without repeating the longest common end/start."""
    for n in range(min(len(left), len(right), longest), 0, -1):
        if left.endswith(right[:n]):
            return left + right[n:]
    glue = "" if left.endswith("\n") or right.startswith("\n") else "\n"
    return left + glue + right


Similarity = Callable[[str, str], float]


def merge_similar(chunks: list[str], similarity: Similarity, threshold: float = 0.75,
                  max_size: int = 2000, overlap: int = 200) -> list[str]:
    merged: list[str] = []
    for chunk in chunks:
        if merged and similarity(merged[-1], chunk) >= threshold:
            joined = join_overlapping(merged[-1], chunk, overlap)
            if len(joined) <= max_size:
                merged[-1] = joined
                continue
        merged.append(chunk)
    return merged


def hashed_similarity(a: str, b: str, buckets: int = 256) -> float:
    """Offline stand-in for an embedding: cosine of hashed word counts, clipped to [0, 1]."""
    va, vb = (np.bincount([crc32(w.encode()) % buckets for w in t.lower().split()] or [0], minlength=buckets)
              for t in (a, b))
    norm = float(np.linalg.norm(va) * np.linalg.norm(vb))
    return min(1.0, max(0.0, float(va @ vb) / norm)) if norm else 0.0


def cut_hybrid(text: str, similarity: Similarity | None = hashed_similarity, size: int = 1000,
               overlap: int = 200, min_size: int = 100, max_size: int = 2000, threshold: float = 0.75,
               lossy: bool = False) -> list[str]:
    """Recursive cut, merge of similar neighbours, then the size limits.

    No text is lost: a chunk above ``max_size`` is cut again, and one below ``min_size``
    goes only if the chunk before ends with it (an overlap repeated it).  With ``lossy``
    all chunks below ``min_size`` go and longer ones end at ``max_size``.
    """
    if not text.strip():
        return []
    chunks = cut_recursive(text, size, overlap, min_size)
    if similarity is not None and len(chunks) > 1:
        chunks = merge_similar(chunks, similarity, threshold, max_size, overlap)
    chunks = [x.strip() for x in chunks]
    if lossy:
        return [c[:max_size] for c in chunks if len(c) >= min_size]
    before = [None, *chunks]
    kept = [c for last, c in zip(before, chunks) if c and (len(c) >= min_size or last is None or not last.endswith(c))]
    return [c[i:i + max_size] for c in kept for i in range(0, len(c), max_size)]


def cut_sentences(text: str, size: int = 1000, overlap: int = 200, apply_overlap: bool = False,
                  early: int = 100, late: int = 50) -> list[str]:
    """Chunks of about ``size`` characters that close with a sentence.

    A chunk closes at the last sentence end from ``early`` characters before its aimed
    length to ``late`` characters behind it, or at that length.  The next one follows
    without a gap; ``apply_overlap`` lets it begin ``overlap`` characters earlier.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sentences = np.flatnonzero(np.isin(codes, [ord(c) for c in SENTENCE_ENDS])) + 1
    spans, begin, stop = [], 0, 0
    while stop < len(text):
        aim = stop = begin + size
        if aim < len(text):
            at = last_break(sentences, aim + late)
            if at >= 0 and sentences[at] > max(aim - early, begin):
                stop = int(sentences[at])
        spans.append((begin, stop))
        begin = max(stop - overlap, begin + 1) if apply_overlap else max(aim - overlap, stop)
    return stripped(text, spans)


# ------------------------------------------------------------- on DataFrames


def splitter(cut: Callable[[str], list[str]]):
    """A column function text -> array<string> from a function on one text."""

    @F.pandas_udf("array<string>")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut(t) if t else [])

    return apply


def split_rows(docs: DataFrame, cut: Callable[[str], list[str]], doc_id: str = "doc_id",
               text: str = "text", name: str = "content") -> DataFrame:
    """(doc columns..., chunk_index, content), one row per chunk.  Whole texts only."""
    keep = [c for c in docs.columns if c != text]
    cuts = docs.select(*keep, splitter(cut)(F.col(text)).alias("_cuts"))
    return cuts.select(*keep, F.posexplode("_cuts").alias("chunk_index", name))


def packed_parents(docs: DataFrame, size: int = PARENT_SIZE, overlap: int = PARENT_OVERLAP) -> DataFrame:
    parents = split_rows(docs.select("doc_id", "text"), lambda t: pack(t, size, overlap))
    return parents.select(
        chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("parent_id"), "doc_id",
        F.col("chunk_index").cast("long").alias("parent_index"), "content",
        F.lit(0).alias("start_char"), F.length("content").alias("end_char"),
    )


def packed_children(parents: DataFrame, size: int = CHILD_SIZE, overlap: int = CHILD_OVERLAP) -> DataFrame:
    children = split_rows(
        parents.select("parent_id", "doc_id", "content"), lambda t: pack(t, size, overlap), text="content", name="child",
    )
    return children.select(
        chunk_id(F.col("parent_id"), F.col("chunk_index")).alias("chunk_id"), "parent_id", "doc_id",
        F.col("chunk_index").cast("long").alias("child_index"), F.col("child").alias("content"),
        F.lit(0).alias("start_char"), F.length("child").alias("end_char"),
    )


def small_to_big(docs: DataFrame, parent_size: int = PARENT_SIZE, parent_overlap: int = PARENT_OVERLAP,
                 child_size: int = CHILD_SIZE, child_overlap: int = CHILD_OVERLAP):
    """Parents and children of every document; an overlap of 0 is honoured."""
    parents = packed_parents(docs, parent_size, parent_overlap)
    return parents, packed_children(parents, child_size, child_overlap)


def chunk_statistics(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Counts and mean lengths; one partial aggregate per table, combined in one row."""
    def sizes(df, kind):
        return df.select(F.lit(kind).alias("kind"), F.length("content").alias("n"))

    both = sizes(parents, "parent").unionByName(sizes(children, "child"))
    is_p = F.col("kind") == "parent"
    agg = both.agg(
        F.count_if(is_p).alias("p"), F.count_if(~is_p).alias("c"),
        F.avg(F.when(is_p, F.col("n"))).alias("ap"), F.avg(F.when(~is_p, F.col("n"))).alias("ac"),
    )
    return agg.select(
        F.col("p").alias("parent_chunks_count"), F.col("c").alias("child_chunks_count"),
        F.round(F.coalesce("ap", F.lit(0.0)), 2).alias("avg_parent_chunk_size"),
        F.round(F.coalesce("ac", F.lit(0.0)), 2).alias("avg_child_chunk_size"),
        F.when(F.col("p") == 0, F.lit(0.0)).otherwise(
            F.round(F.col("c") / F.nullif(F.col("p"), F.lit(0)), 2)
        ).alias("avg_children_per_parent"),
    )


def typed_chunks(docs: DataFrame, cut: Callable[[str], list[str]]) -> DataFrame:
    """Text, table and reference chunks of documents(doc_id, filename, text, tables, references)."""
    from corpusweir.functions.text import language

    body = split_rows(docs.select("doc_id", "filename", "text"), cut).withColumn("chunk_type", F.lit("text"))
    parts = [body]
    for column, kind in (("tables", "table"), ("references", "reference")):
        if column in docs.columns:
            parts.append(
                docs.select("doc_id", "filename", F.posexplode(column).alias("chunk_index", "content"))
                .withColumn("chunk_type", F.lit(kind))
            )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("language", language(F.col("content")))


def element_chunks(elements: DataFrame) -> DataFrame:
    """Elements(doc_id, position, type, text) to chunk rows with a coarse type; blanks drop out."""
    kind = F.lower("type")
    typed = elements.filter(strip(F.coalesce("text", F.lit(""))) != "").select(
        "doc_id", "position", strip(F.col("text")).alias("content"),
        F.when(kind.contains("table"), "table")
        .when(kind.contains("title") | kind.contains("header"), "title")
        .when(kind.contains("list"), "list").otherwise("text").alias("chunk_type"),
    )
    return typed
