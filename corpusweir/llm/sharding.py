"""Proportional stratified interleaving.

Rows are shuffled by a seeded key within their source and ranked there; the rank
divided by the source's size is a fraction between 0 and 1.  In the order of that
fraction every stretch of rows has the mixture of the whole, so equal cuts give
shards that all match it and differ by one row at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweir.operators.ordering import positions
from corpusweir.session import written_table


def seeded_key(seed: int, *columns: str) -> Column:
    """A pseudo-random key that any engine with MD5 can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def text_size(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + 16


def source_key(source: Column) -> Column:
    """Sources in code-point order, null as a source of its own after all others."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def interleaved_shards(
    docs: DataFrame,
    shards: int = 40,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Every row with its shard (0 to ``shards`` - 1) and its slot there (gapless from 0).

    Returns ``id_col``, size, text_crc32, shard, slot and the columns of ``carry``.  Only
    these travel: sizes and checksums are taken where the text is read, and the two range
    shuffles move narrow rows, of which a source of any size fills as many tasks as it
    needs.  Null sources are one source; null texts have size 16 and the checksum of the
    empty text; null ids take part; repeated rows are rows of their own, and rows that
    agree in all of it are interchangeable.  Fewer rows than shards leave shards empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        text_size(F.col(text_col)).alias("_size"),
        F.crc32(text).alias("_crc"),
        source_key(F.col(source_col)).alias("_source"),
        *[F.col(c).alias(f"_carry_{i}") for i, c in enumerate(carry)],
    ).withColumn("_key", seeded_key(seed, "_id", "_crc"))
    # Written, as the sampling and the sort of a range shuffle would each read the texts.
    rows = written_table(rows)
    ranked = positions(rows, ["_source"], [F.col("_key"), F.col("_id")], "_rank")
    totals = ranked.groupBy("_source").agg(F.count("*").alias("_n"))
    placed = ranked.join(totals, "_source").withColumn(
        "_part", (2 * F.col("_rank") - 1) / (2 * F.col("_n"))
    )
    order = [F.col(c) for c in ("_part", "_source", "_key", "_id")]
    n = rows.count()
    laid = positions(placed.drop("_rank", "_n"), [], order, "_at")
    at = F.col("_at") - 1
    laid = laid.withColumn("_shard", F.expr(f"((_at - 1) * {shards}) div {max(n, 1)}").cast("int"))
    begin = F.expr(f"(_shard * {n}L + {shards - 1}) div {shards}")
    return laid.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.col("_shard").alias("shard"),
        (at - begin).cast("long").alias("slot"),
        *[F.col(f"_carry_{i}").alias(c) for i, c in enumerate(carry)],
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, **options) -> None:
    """The documents, whole rows in ``row``, as Parquet folders ``shard=0 .. shard=N-1`` in slot order."""
    whole = docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    laid = interleaved_shards(whole, shards, carry=["_row"], **options)
    (
        laid.select("shard", "slot", F.col("_row").alias("row"))
        .repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard").parquet(path)
    )
