"""Reads, listings and rewrites of the relational tables.

Rewrites return the new state of a table; the caller writes it.  Without a
transactional table format that is an anti join or a keyed union, both of which
shuffle by the primary key only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusweir.functions.text import strip
from corpusweir.operators.topk import top_k


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page with the totals of the listing.

    Sort and limit become a top-k per task; the total is a partial count.
    """
    if limit <= 0 or offset < 0:
        raise ValueError("limit must be positive and offset must not be negative")
    rows = df.orderBy(*order).offset(offset).limit(limit)
    total = df.agg(F.count("*")).scalar()
    return rows.withColumn("total", total).withColumns({
        "page": F.lit(offset // limit + 1).cast("long"),
        "pages": F.ceil(F.col("total") / limit).cast("long"),
    })


def page_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int, number: int = 1):
    """Page ``number`` of every group; only the rows up to its end are shuffled."""
    if not 1 <= limit <= 100:
        raise ValueError("page size must be within 1..100")
    ranked = top_k(df, keys, order, limit * number, "row")
    return ranked.filter(F.col("row") > limit * (number - 1))


def where(df: DataFrame, conditions: dict[str, object | None]) -> DataFrame:
    """Conjunction of equality conditions; ``None`` means no condition."""
    given = [F.col(c) == v for c, v in conditions.items() if v is not None]
    return df.filter(reduce(lambda a, b: a & b, given)) if given else df


def non_empty(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & (F.col(column) != ""))


def by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """IN-list fetch."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def session_listing(sessions: DataFrame, messages: DataFrame, include_empty: bool = False) -> DataFrame:
    """Sessions with their message counts.

    Messages are counted per session before the join, so a session holding a
    third of all messages reaches it as one row.
    """
    counts = messages.groupBy("session_id").agg(F.count("*").alias("message_count"))
    joined = sessions.filter("is_active").join(counts, "session_id", "left").withColumn(
        "message_count", F.coalesce("message_count", F.lit(0)).cast("long")
    )
    if not include_empty:
        joined = joined.filter("message_count > 0")
    return joined.withColumn("status", F.when(F.col("message_count") > 0, "active").otherwise("empty"))


def history(messages: DataFrame, limit: int = 50) -> DataFrame:
    """First ``limit`` messages of every session in order."""
    return top_k(messages, ["session_id"], [F.asc("position")], limit, "row")


def keyword_list(raw: Column) -> Column:
    """Keywords from a JSON array, else from a comma list."""
    as_json = F.when(raw.startswith("["), F.from_json(raw, "array<string>"))
    as_list = F.filter(F.transform(F.split(raw, ","), strip), lambda k: k != "")
    return F.coalesce(as_json, as_list)


def flatten_metadata(scalars: dict[str, Column], lists: dict[str, Column]) -> list[Column]:
    """Scalars are kept; a list becomes its length as ``{key}_count``."""
    return [c.alias(k) for k, c in scalars.items()] + [
        F.size(c).cast("long").alias(f"{k}_count") for k, c in lists.items()
    ]


def metadata_contains(df: DataFrame, keyword: str, lists: Sequence[str], text: str) -> DataFrame:
    """Keyword in any of the list columns or inside the text."""
    hit = F.col(text).contains(keyword)
    for column in lists:
        hit = hit | F.array_contains(F.col(column), keyword)
    return df.filter(hit)


# ------------------------------------------------------------------- rewrites


def upsert(base: DataFrame, changes: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """Insert or replace by key.

    Of several changes of a key the newest by ``version`` counts; without a version
    ``changes`` holds at most one row per key.
    """
    if version:
        changes = latest_versions(changes, key, version).select(*changes.columns)
    return base.join(changes.select(key), key, "left_anti").unionByName(changes)


def latest_versions(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Newest row per key (upserts replayed from a log, combined map-side)."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.col(version)).alias("r")).select(key, "r.*")


def patch(base: DataFrame, changes: DataFrame, key: str, allowed: Sequence[str],
          touch: str | None = None, now: Column | None = None) -> DataFrame:
    """Dynamic UPDATE: given non-null values replace old ones, for ``allowed`` columns."""
    fields = [c for c in allowed if c in changes.columns]
    renamed = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields], F.lit(True).alias("_hit"))
    out = base.join(renamed, key, "left")
    for c in fields:
        out = out.withColumn(c, F.coalesce(f"_new_{c}", c))
    if touch:
        out = out.withColumn(touch, F.when(F.col("_hit"), now if now is not None else F.current_timestamp())
                             .otherwise(F.col(touch)))
    return out.drop("_hit", *[f"_new_{c}" for c in fields])


def hard_delete(base: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return base.join(ids, key, "left_anti")


def soft_delete(base: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    gone = ids.select(key).distinct().withColumn("_gone", F.lit(True))
    return base.join(gone, key, "left").withColumn(
        "is_active", F.col("is_active") & F.col("_gone").isNull()
    ).drop("_gone")


def cascade_delete(document_ids: DataFrame, tables: dict[str, DataFrame], key: str = "document_id"):
    """Delete the rows of a document from its own and every dependent table."""
    return {name: hard_delete(df, document_ids, key) for name, df in tables.items()}


def merge_metadata(df: DataFrame, column: str, extra: dict[str, Column]) -> DataFrame:
    """Map update: new keys are added and existing ones replaced."""
    added = F.create_map(*[x for k, v in extra.items() for x in (F.lit(k), v)])
    kept = F.map_filter(F.col(column), lambda k, _: ~k.isin(list(extra)))
    return df.withColumn(column, F.map_concat(kept, added))


def vector_rows(chunks: DataFrame) -> DataFrame:
    """Id of a vector: the chunk's own id, else document and position."""
    fallback = F.format_string("%s_chunk_%d", F.col("document_id"), F.col("chunk_index"))
    return chunks.withColumn("id", F.coalesce(F.nullif(F.col("chunk_id"), F.lit("")), fallback))


# ---------------------------------------------------------- consistency checks


def orphans(vectors: DataFrame, valid: DataFrame, key: str = "document_id", null_is_orphan: bool = True):
    """Vectors whose document does not exist (an id set of any size)."""
    rows = vectors.join(valid.select(key), key, "left_anti")
    return rows if null_is_orphan else rows.filter(F.col(key).isNotNull())


def orphan_stats(vectors: DataFrame, valid: DataFrame, key: str = "document_id") -> DataFrame:
    """Totals of vectors and of orphaned vectors and documents."""
    per_doc = vectors.groupBy(key).agg(F.count("*").alias("n"))
    marked = per_doc.join(valid.select(key).distinct().withColumn("_ok", F.lit(True)), key, "left")
    orphan = F.col("_ok").isNull()
    return marked.agg(
        F.sum("n").cast("long").alias("total_chunks"),
        F.coalesce(F.sum(F.when(orphan, F.col("n"))), F.lit(0)).cast("long").alias("orphaned_chunks"),
        F.count_if(orphan).alias("orphaned_documents"),
        F.count_if(~orphan).alias("valid_documents"),
    )


def remove_orphans(vectors: DataFrame, valid: DataFrame, key: str = "document_id", dry_run: bool = True):
    """Survivors of the clean-up; refuses to run without any valid id."""
    if valid.limit(1).count() == 0:
        raise ValueError("no valid document ids: refusing to treat every vector as orphaned")
    return vectors if dry_run else vectors.join(valid.select(key).distinct(), key, "left_semi")


def adjacent_pairs(chunks: DataFrame, doc: str, order: str, content: str) -> DataFrame:
    """Every chunk beside its successor.

    The pairing is an equi join on the position, so a document holding a third
    of all chunks is spread by position as well.
    """
    left = chunks.select(doc, order, F.col(content).alias("current"))
    right = chunks.select(doc, (F.col(order) - 1).alias(order), F.col(content).alias("following"))
    return left.join(right, [doc, order])


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two word arrays; 0 when either is empty."""
    inter = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(inter / F.nullif(union, F.lit(0)))


def processing_stats(docs: DataFrame, dims: Sequence[str], size: str) -> DataFrame:
    """Counts and sizes by every dimension and in total, in one pass."""
    grouped = docs.select(*dims, size).groupingSets(
        [[F.col(d)] for d in dims] + [[]], *[F.col(d) for d in dims]
    )
    return grouped.agg(
        F.grouping_id().alias("_g"), F.count("*").alias("n"), F.sum(size).cast("long").alias("total_size")
    ).select(
        _label(dims), F.coalesce(*[F.col(d).cast("string") for d in dims], F.lit("")).alias("value"),
        "n", "total_size",
    )


def _label(dims: Sequence[str]) -> Column:
    """Name of the dimension a grouping-set row belongs to."""
    full = (1 << len(dims)) - 1
    cases = [F.when(F.col("_g") == full ^ (1 << (len(dims) - 1 - i)), F.lit(d)) for i, d in enumerate(dims)]
    return F.coalesce(*cases, F.lit("total")).alias("dimension")
