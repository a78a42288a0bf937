"""Mixing sources to target weights, with DataFrame functions only.

Every source has a target number of words.  Its documents get hash-random keys, are
range-sorted by them and summed up along that order; whole epochs are taken while the
target allows, and the last one is cut at the exact budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweir.llm.sharding import seeded_key, source_key
from corpusweir.operators.ordering import positions, prefix_sums
from corpusweir.session import written_table

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``sources(_source, _source_size)`` with ``_target``, the words to take of each.

    In the order of ``_source`` the weights repeat.  All targets together are the words of
    all sources; no target is above ``most`` times its source, and what is cut off there is
    shared by the others by weight.  That is the level L with sum(min(cap, weight * L)) =
    total: along the order of cap / weight the sources below the level are a prefix, and
    running sums give each source the level that would hold if those before it were capped.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("_nth") - 1) % len(weights) + 1).cast("int"))
    ranked = positions(sources, [], [F.col("_source")], "_nth").select(
        "*", w.alias("_w"), (F.col("_source_size") * most).alias("_cap")
    )
    ranked = written_table(ranked.withColumn("_ratio", F.col("_cap") / F.col("_w")))
    total, weight = ranked.agg(F.sum("_source_size"), F.sum("_w")).first()
    if not total:
        return ranked.select("_source", F.lit(0.0).alias("_target"))
    order = [F.col("_ratio"), F.col("_source")]
    summed = prefix_sums(ranked, [], order, {"_cap_sum": "_cap", "_w_sum": "_w"})
    level = (F.lit(float(total)) - (F.col("_cap_sum") - F.col("_cap"))) / (
        F.lit(float(weight)) - (F.col("_w_sum") - F.col("_w"))
    )
    summed = written_table(summed.withColumn("_level", level))
    found = summed.filter("_ratio > _level").agg(F.min_by("_level", F.struct("_ratio", "_source"))).first()[0]
    target = F.when(F.col("_ratio") > F.col("_level"), F.col("_w") * F.lit(found)).otherwise(F.col("_cap").cast("double"))
    return summed.select("_source", target.alias("_target"))


def mix_plan(
    docs: DataFrame,
    weights: tuple[float, ...] = (1, 2, 3),
    most: int = 3,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """What the mix takes of every document.

    Returns ``id_col``, size, source_size, target, whole (times the document is taken
    whole), part (words of one more, cut copy; 0 if none), taken (words in all) and the
    columns of ``carry``.  The documents after the cut are not taken in that epoch, so only
    one document of a source is cut.  Null texts have size 0; null sources are one source,
    the last; null ids and repeated rows are rows like others.  An empty table gives an
    empty plan; with no word in it all targets are 0.
    """
    rows = docs.select(
        F.col(id_col).alias("_id"),
        word_count(F.col(text_col)).alias("_size"),
        source_key(F.col(source_col)).alias("_source"),
        *[F.col(c).alias(f"_carry_{i}") for i, c in enumerate(carry)],
    ).withColumn("_key", seeded_key(seed, "_id", "_size"))
    # Written, as the sampling and the sort of a range shuffle would each read the texts.
    rows = written_table(rows)
    summed = written_table(prefix_sums(rows, ["_source"], [F.col("_key"), F.col("_id")], {"_upto": "_size"}))
    sources = written_table(summed.groupBy("_source").agg(F.sum("_size").alias("_source_size")))
    budget = targets(sources, weights, most).join(sources, "_source").select(
        "_source", "_source_size", "_target",
        F.least(F.round("_target").cast("long"), F.col("_source_size") * most).alias("_words"),
    ).withColumn("_whole", F.expr("if(_source_size > 0, _words div _source_size, 0L)"))
    rest = F.col("_words") - F.col("_whole") * F.col("_source_size")
    before = F.col("_upto") - F.col("_size")
    part = F.greatest(F.lit(0), F.least(F.col("_size"), rest - before)).cast("long")
    return summed.join(budget, "_source").select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        F.col("_whole").alias("whole"),
        part.alias("part"),
        (F.col("_whole") * F.col("_size") + part).alias("taken"),
        *[F.col(f"_carry_{i}").alias(c) for i, c in enumerate(carry)],
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space as it stands."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, in the same columns.

    A cut copy holds the first words of its text and, if there is such a column, its own
    ``n_chars``.  Documents are found again by id and text hash; rows that agree in both
    are told apart by a number, so each is taken as planned.  A document without words
    costs nothing and stays once.
    """
    names = {k: options.pop(k, d) for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    id_col, text_col, source_col = names.values()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # The row travels as one column, so no name of its own can clash.
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"),
        F.xxhash64(*columns).alias("hash"), F.struct(*columns).alias("row"),
    )
    plan = mix_plan(rows, id_col="id", carry=("hash",), **options)
    # Rows that agree in everything are one group: their takings are listed together.
    whole = F.array_repeat(F.lit(-1).cast("long"), F.col("whole").cast("int"))
    last = F.when(F.col("part") == F.col("size"), F.array(F.lit(-1).cast("long"))).when(F.col("part") > 0, F.array("part"))
    takes = F.when(F.col("size") == 0, F.array(F.lit(-1).cast("long"))).otherwise(
        F.concat(whole, last.otherwise(F.array().cast("array<bigint>")))
    )
    takings = plan.select(F.col("id").alias("_id"), F.col("hash").alias("_hash"), takes.alias("_takes")).filter(F.size("_takes") > 0)
    repeats = takings.groupBy("_hash", "_id", "_takes").agg(F.count("*").alias("_rows"))
    each = repeats.select("_hash", "_id", "_takes", F.explode(F.sequence(F.lit(1), F.col("_rows")))).select(
        "_hash", "_id", F.explode("_takes").alias("_take")
    )
    single = rows.select("id", "hash", "row").dropDuplicates(["hash", "id"])
    out = single.join(each, (F.col("hash") == F.col("_hash")) & F.col("id").eqNullSafe(F.col("_id")))
    cut = F.col("_take") >= 0
    text = F.when(cut, first_words(F.col("row").getField(text_col), F.col("_take"))).otherwise(F.col("row").getField(text_col))
    return out.select(*renewed(docs, text_col, text, cut))


def renewed(docs: DataFrame, text_col: str, text: Column, changed: Column) -> list[Column]:
    """The columns of ``docs`` out of ``row``, with another text and its own length where it changed."""
    out = []
    for c in docs.columns:
        value = F.col("row").getField(c)
        if c == text_col:
            value = text
        elif c == "n_chars":
            value = F.when(changed, F.char_length(text)).otherwise(value).cast(docs.schema[c].dataType)
        out.append(value.alias(c))
    return out
