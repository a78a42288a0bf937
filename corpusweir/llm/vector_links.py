"""Near-duplicate vectors of one label, by dual traversal of cover trees.

Equal vectors are one row with a weight.  The rows of a label that fit one block make one
tree.  A larger label is divided by pivots, and each pivot's rows by nested balls of halving
radii around it; these shells are the upper nodes of the tree.  Per label a task walks the
pairs of shells: those too far apart are dropped, those that must be close as a whole are
counted without comparing anything, and only the others meet, block by block, as trees.
A cloud of near copies of any size lies in an inner ball and costs nothing but its count.
No pairs of rows leave a task: a row has its number of links and one row it hangs on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweir.llm.components import components
from corpusweir.llm.cover_tree import SLACK, CloseRows, apart, unit_rows
from corpusweir.session import bounded_broadcast, written_table

COSINE = 0.93
#: Distinct vectors of a block; a task holds two blocks.
BLOCK = 8192
#: Pivots of a label at most, and vectors of a label they are chosen among (about).
PIVOTS, SAMPLE = 256, 4096
NONE = 2**63 - 1
GROUP = ["_label", "_width"]
KEY = "struct<id:bigint,salt:bigint>"


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _pivots(count: int):
    """Farthest-first among a sample: one row with all pivots of the label."""

    def run(table: pa.Table) -> pa.Table:
        x = _matrix(table.column("_v"))
        units, chosen = unit_rows(x), [0]
        gap = apart(units, units[:1])[:, 0]
        most = min(count, 2 * table.column("_pieces")[0].as_py())
        while len(chosen) < most and gap.max() > SLACK:
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, apart(units, units[chosen[-1] :][:1])[:, 0])
        return pa.table({
            "_label": table.column("_label").slice(0, 1), "_width": table.column("_width").slice(0, 1),
            "_at": pa.array([units[chosen].ravel().tolist()], pa.list_(pa.float64())),
        })

    return run


def _inner(cosine: float) -> float:
    """Radius of a ball whose vectors are close to each other, whatever they are."""
    return 0.49 * float(np.sqrt(2 - 2 * cosine))


def _placed(cosine: float):
    """Each row's pivot, distance to it and shell."""

    def run(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        x = unit_rows(_matrix(rows.column("_v"))) if rows.num_rows else np.zeros((0, 1))
        at = np.array(pivots.column("_at")[0].as_py()).reshape(-1, x.shape[1]) if rows.num_rows else np.zeros((1, 1))
        cell = (x @ at.T).argmax(axis=1)
        gap = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", x, at[cell]), 0))
        shell = np.ceil(np.log2(np.maximum(gap / _inner(cosine), 1)))
        return pa.table({
            **{c: rows.column(c) for c in (*GROUP, "_key", "_v", "_m")},
            "_node": pa.array((cell * 16 + shell).astype(np.int32)), "_gap": pa.array(gap),
        })

    return run


def _node_pairs(cosine: float):
    """Pairs of shells that need a look, and those that are close as a whole."""
    limit = float(np.sqrt(2 - 2 * cosine))

    def run(nodes: pa.Table, pivots: pa.Table) -> pa.Table:
        node, low, high = (nodes.column(c).to_numpy() for c in ("_node", "_low", "_high"))
        at = np.array(pivots.column("_at")[0].as_py()).reshape(-1, pivots.column("_width")[0].as_py())
        centre = at[node // 16]
        firsts, seconds, whole = [], [], []
        for i in range(len(node)):
            gap = apart(centre[i : i + 1], centre[i:])[0]
            nearest = np.maximum.reduce([gap - high[i] - high[i:], low[i] - gap - high[i:], low[i:] - gap - high[i]])
            js = np.flatnonzero(nearest <= limit + SLACK)
            firsts += [i] * len(js)
            seconds += (js + i).tolist()
            whole += (gap[js] + high[i] + high[i:][js] < limit - SLACK).tolist()
        one = [nodes.column(c).slice(0, 1).combine_chunks().take(pa.array([0] * len(firsts))) for c in GROUP]
        pick = lambda c, at: nodes.column(c).take(pa.array(at, pa.int64()))
        return pa.table(
            [*one, pick("_node", firsts), pick("_node", seconds), pick("_blocks", firsts), pick("_blocks", seconds),
             pick("_rep", firsts), pick("_rep", seconds), pick("_weight", firsts), pick("_weight", seconds), pa.array(whole, pa.bool_())],
            names=[*GROUP, "_a", "_b", "_na", "_nb", "_repa", "_repb", "_wa", "_wb", "_whole"],
        )

    return run


def _compare(cosine: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = pa.concat_tables([left.select(["_key", "_v", "_m"]), right.select(["_key", "_v", "_m"])]).combine_chunks()
        found = CloseRows(_matrix(rows.column("_v")), rows.column("_m").to_numpy(), left.num_rows, cosine) if left.num_rows else None
        total, root = (found.total, found.roots()) if found else (np.zeros(rows.num_rows, np.int64), np.arange(rows.num_rows))
        some = np.flatnonzero(total)
        return pa.table({
            "_key": rows.column("_key").take(pa.array(some)), "w": pa.array(total[some]),
            "_on": rows.column("_key").take(pa.array(root[some])),
        })

    return run


def _upper_nodes(distinct: DataFrame, sizes: DataFrame, cosine: float, block: int, pivots: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the labels beyond one block: rows with their units, pairs of units, and what is close as a whole."""
    big = distinct.join(bounded_broadcast(sizes.filter("_pieces > 1")), GROUP)
    label = dict(distinct.dtypes)["_label"]
    sampled = big.filter(F.pmod(F.xxhash64("_v"), F.lit(1_000_003)) < F.lit(1_000_003.0) * SAMPLE / F.col("_rows"))
    chosen = written_table(sampled.select(*GROUP, "_v", "_pieces").groupBy(*GROUP).applyInArrow(
        _pivots(pivots), f"_label {label}, _width int, _at array<double>"
    ))
    salted = sizes.filter("_pieces > 1").join(chosen, GROUP).select(
        *GROUP, F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)).alias("_salt"), "_at"
    )
    rows = big.withColumn("_salt", F.expr("cast(pmod(xxhash64(_key), _pieces) as int)")).drop("_rows", "_pieces")
    key = [*GROUP, "_salt"]
    placed = written_table(rows.groupBy(*key).cogroup(salted.groupBy(*key)).applyInArrow(
        _placed(cosine), f"_label {label}, _width int, _key {KEY}, _v array<double>, _m bigint, _node int, _gap double"
    ))
    nodes = written_table(placed.groupBy(*GROUP, "_node").agg(
        F.min("_gap").alias("_low"), F.max("_gap").alias("_high"), F.sum("_m").alias("_weight"), F.min("_key").alias("_rep"),
        F.ceil(F.count("*") / block).cast("int").alias("_blocks"),
    ))
    pairs = written_table(nodes.groupBy(*GROUP).cogroup(chosen.groupBy(*GROUP)).applyInArrow(
        _node_pairs(cosine),
        f"_label {label}, _width int, _a int, _b int, _na int, _nb int, _repa {KEY}, _repb {KEY}, _wa bigint, _wb bigint, _whole boolean",
    ))
    units = placed.join(bounded_broadcast(nodes.select(*GROUP, "_node", "_blocks")), [*GROUP, "_node"]).select(
        *GROUP, F.struct("_node", F.expr("cast(pmod(xxhash64(_key), _blocks) as int)").alias("_block")).alias("_unit"), "_key", "_v", "_m"
    )
    blocks = pairs.filter("not _whole").withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_na") - 1))).withColumn(
        "_j", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))
    ).filter("_a <> _b or _i <= _j").select(
        *GROUP, F.struct(F.col("_a").alias("_node"), F.col("_i").alias("_block")).alias("_ua"),
        F.struct(F.col("_b").alias("_node"), F.col("_j").alias("_block")).alias("_ub"),
    )
    # A node close as a whole to others: their weights, and one of their rows to hang on.
    whole = pairs.filter("_whole")
    both = whole.select(*GROUP, F.col("_a").alias("_node"), F.col("_wb").alias("w"), F.col("_repb").alias("_on")).union(
        whole.filter("_a <> _b").select(*GROUP, "_b", "_wa", "_repa")
    )
    joined = both.groupBy(*GROUP, "_node").agg(F.sum("w").alias("w"), F.min("_on").alias("_on"))
    counted = placed.join(bounded_broadcast(joined), [*GROUP, "_node"]).select("_key", "w", "_on")
    tied = whole.filter("_a <> _b").select(F.col("_repa").alias("_key"), F.lit(0).cast("bigint").alias("w"), F.col("_repb").alias("_on"))
    return units, blocks, counted.union(tied)


def vector_links(
    vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, pivots: int = PIVOTS,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """How vectors of one label hang together: vec_id, n_links, component_id, kept for every row.

    Two rows are linked if their labels are equal and not null and the cosine of their
    vectors, in double precision, is ``cosine`` or more.  ``component_id`` is the smallest id
    reachable by links, ``kept`` says that it is the row's own.  Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing, nor do vectors of different
    lengths.  Repeated rows are rows: copies link with each other.  A row without id links as
    others do and lends no id to its component; alone, it has none and is kept.  Other columns
    are ignored.  All pairs are found, whatever the block size and the number of pivots.
    """
    x = F.col(vector_col)
    good = F.col(label_col).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("_label"),
        F.when(good, F.transform(x, lambda v: v.cast("double") + F.lit(0.0))).alias("_v"),
    )
    distinct = written_table(
        rows.filter(F.col("_v").isNotNull()).groupBy("_label", "_v").agg(F.count("*").alias("_m"), F.min("vec_id").alias("_id"))
        .select("_label", F.size("_v").alias("_width"), "_v", "_m",
                F.struct(F.coalesce("_id", F.lit(NONE)).alias("id"), F.xxhash64("_label", "_v").alias("salt")).alias("_key"))
    )
    sizes = written_table(distinct.groupBy(*GROUP).agg(F.count("*").alias("_rows")).withColumn(
        "_pieces", F.ceil(F.col("_rows") / block).cast("int")
    ))
    alone = F.struct(F.lit(0).alias("_node"), F.lit(0).alias("_block"))
    left = distinct.join(bounded_broadcast(sizes.filter("_pieces = 1").select(*GROUP)), GROUP).select(
        *GROUP, alone.alias("_ua"), alone.alias("_ub"), "_key", "_v", "_m"
    )
    right, more = vectors.sparkSession.createDataFrame([], left.schema), None
    if not sizes.filter("_pieces > 1").isEmpty():
        units, blocks, more = _upper_nodes(distinct, sizes, cosine, block, pivots)
        first = units.withColumnRenamed("_unit", "_ua").join(blocks, [*GROUP, "_ua"])
        second = units.withColumnRenamed("_unit", "_ub").join(blocks.filter("_ua <> _ub"), [*GROUP, "_ub"])
        left = left.union(first.select(*left.columns))
        # Other names: both sides of a cogroup must not be the same columns.
        right = second.select(*[F.col(c).alias(c) for c in left.columns])
    key = [*GROUP, "_ua", "_ub"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_compare(cosine), f"_key {KEY}, w bigint, _on {KEY}")
    found = written_table(found.union(more) if more is not None else found)
    roots = components(found.select(F.col("_key").alias("a"), F.col("_on").alias("b")))
    totals = found.groupBy("_key").agg(F.sum("w").alias("w"))
    marked = distinct.join(totals, "_key", "left").join(roots.withColumnRenamed("id", "_key"), "_key", "left").select(
        "_label", "_v", (F.coalesce("w", F.col("_m")) - 1).alias("_n"), F.coalesce(F.col("root.id"), F.col("_key.id")).alias("_c")
    )
    component = F.when(F.col("_c").isNull(), F.col("vec_id")).otherwise(F.nullif(F.col("_c"), F.lit(NONE)))
    return rows.join(marked, ["_label", "_v"], "left").select(
        "vec_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
