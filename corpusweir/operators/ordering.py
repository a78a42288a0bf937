"""Ordered computations on groups of any size.

A plain window puts a whole group into one task.  Here the rows are range
partitioned by (keys, order) so that a group holding a third of the data is
spread over many segments; each segment is folded on its own and the per-segment
totals, of which there are at most as many as partitions, are combined after.
The segmented rows are written to the shared folder once: range boundaries come
from sampling and must not move between the pass that totals and the pass that applies.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusweir.session import checkpointed, written_table

SEG = "_seg"


def segmented(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    # Without a fixed number AQE merges small segments; the written table fixes the rest.
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    return written_table(ranged.withColumn(SEG, F.spark_partition_id()))


def _carry(totals: DataFrame, keys: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """Sums of the earlier segments of a key, for keys that span segments.

    A range boundary can split one key only, so the rows left by the filter
    number at most the partitions and the broadcast is bounded by that.
    """
    before = (
        Window.partitionBy(*keys)
        .orderBy(SEG)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    first = Window.partitionBy(*keys).orderBy(SEG)
    out = totals.withColumn("_nth", F.row_number().over(first))
    for name in sums:
        out = out.withColumn(f"_before_{name}", F.sum(f"_total_{name}").over(before))
    return F.broadcast(
        out.filter("_nth > 1").select(*keys, SEG, *[f"_before_{name}" for name in sums])
    )


def prefix_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: dict[str, str]
) -> DataFrame:
    """Add ``{name: expression}`` running sums per key, current row included."""
    seg = segmented(df, keys, order)
    totals = seg.groupBy(*keys, SEG).agg(
        *[F.sum(F.expr(e)).alias(f"_total_{n}") for n, e in sums.items()]
    )
    local = Window.partitionBy(*keys, SEG).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    out = seg
    for name, expression in sums.items():
        out = out.withColumn(name, F.sum(F.expr(expression)).over(local))
    out = out.join(_carry(totals, keys, sums), [*keys, SEG], "left")
    for name in sums:
        carried = F.coalesce(F.col(f"_before_{name}"), F.lit(0))
        out = out.withColumn(name, F.col(name) + carried).drop(f"_before_{name}")
    return out.drop(SEG)


def positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "position"
) -> DataFrame:
    """1-based position in the total order of the key (a row_number that scales)."""
    return prefix_sums(df, keys, order, {name: "1"})


def floor_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float]
) -> DataFrame:
    """Value at sorted index ``min(int(n*p), n-1)`` per key, for every point.

    Equal values are counted before anything is ordered, so only distinct
    values travel.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    running = prefix_sums(counted, keys, [F.col(value)], {"_cum": "_c"})
    sizes = counted.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    joined = running.join(sizes, list(keys))
    picks = []
    for name, p in points.items():
        index = F.least(F.floor(F.col("_n") * F.lit(p)), F.col("_n") - 1)
        here = (F.col("_cum") > index) & (F.col("_cum") - F.col("_c") <= index)
        picks.append(F.max(F.when(here, F.col(value))).alias(name))
    return joined.groupBy(*keys).agg(*picks)


def running_mean(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, name: str = "running_mean"
) -> DataFrame:
    out = prefix_sums(df, keys, order, {"_s": value, "_k": "1"})
    return out.withColumn(name, F.col("_s") / F.col("_k")).drop("_s", "_k")


def ewma(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    alpha: float = 0.1,
    initial: float = 0.0,
    name: str = "ewma",
) -> DataFrame:
    """``e = (1-alpha)*e + alpha*x`` from ``initial``, in ``order`` per key.

    The recurrence is an affine map, so every segment is folded from zero in
    Arrow batches and the carried-in value is added afterwards, scaled by
    ``(1-alpha)^i`` at the i-th row of the segment.
    """
    keys = list(keys)
    seg = segmented(df, keys, [F.col(c) for c in order])
    schema = T.StructType(
        [*seg.schema.fields, T.StructField("_local", T.DoubleType()), T.StructField("_i", T.LongType())]
    )
    keep = 1.0 - alpha

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, count = None, 0.0, 0
        for pdf in batches:
            if pdf.empty:
                continue
            local = pd.Series(0.0, index=pdf.index)
            index = pd.Series(0, index=pdf.index)
            group = pd.Series(pd.MultiIndex.from_frame(pdf[[*keys, SEG]]).to_list(), index=pdf.index)
            runs = (group != group.shift()).cumsum()
            for _, rows in pdf.groupby(runs, sort=False):
                key = group.loc[rows.index[0]]
                if key != current:
                    current, state, count = key, 0.0, 0
                xs = pd.concat([pd.Series([state]), rows[value].astype(float)], ignore_index=True)
                folded = xs.ewm(alpha=alpha, adjust=False).mean().iloc[1:].to_numpy()
                local.loc[rows.index] = folded
                index.loc[rows.index] = range(count + 1, count + len(rows) + 1)
                state, count = folded[-1], count + len(rows)
            yield pdf.assign(_local=local, _i=index)

    by_segment = seg.repartition(*keys, SEG)
    folded = checkpointed(
        by_segment.sortWithinPartitions(*keys, SEG, *order).mapInPandas(fold, schema)
    )
    ends = folded.groupBy(*keys, SEG).agg(
        F.max("_i").alias("n"), F.max_by("_local", "_i").alias("last")
    )
    # One array per key, as long as its number of segments at most.
    chain = ends.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(SEG, "n", "last"))).alias("_chain")
    )
    carried = chain.select(*keys, F.explode(F.transform(
        F.sequence(F.lit(1), F.size("_chain")),
        lambda i: F.struct(
            F.element_at("_chain", i)[SEG].alias(SEG),
            F.aggregate(
                F.slice("_chain", F.lit(1), i - 1), F.lit(float(initial)),
                lambda acc, s: acc * F.pow(F.lit(keep), s["n"]) + s["last"],
            ).alias("carry"),
        ),
    )).alias("s")).select(*keys, f"s.{SEG}", "s.carry").filter("carry <> 0")
    out = folded.join(carried, [*keys, SEG], "left")
    return out.withColumn(
        name,
        F.col("_local") + F.coalesce(F.col("carry"), F.lit(0.0)) * F.pow(F.lit(keep), F.col("_i")),
    ).drop("_local", "_i", "carry", SEG)
