"""Connected components of a link table by alternating stars.

Every node is linked to the smallest node it knows, first among its larger, then among
its smaller neighbours, until nothing changes.  All state is a table in the shared
folder; nothing is collected but a count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweir.session import written_table


def components(links: DataFrame) -> DataFrame:
    """``(id, root)`` of every node of ``links(a, b)`` that is not its own root.

    The root is the smallest id of the component.  Null ends and loops are ignored.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, known = written_table(edges), None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
            .alias("e")
        ).select("e.u", "e.v").filter("u <> v").distinct()
        edges = written_table(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == known:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        known = state
