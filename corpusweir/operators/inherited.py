"""Text search over children that have some fields from their parents.

All children of a parent score alike in a field they inherit, so that field is counted and
scored once per parent: a parent weighs as many documents as it has children.  The best
``k`` parents hold the best ``k`` children, since every parent has a child whose id is its own
and ``-0``; their children are looked up and ranked again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweir.functions.text import token_line
from corpusweir.operators import bm25
from corpusweir.session import checkpointed, is_few, lookup_join, written_table


@dataclass(frozen=True)
class InheritedSearch:
    """``children(doc_id, parent_id, <own>)``, ``parents(parent_id, n_children, <inherited>)``.

    ``lined`` says that own fields are given as their ``token_line``: they are not tokenised again.
    """

    children: DataFrame
    parents: DataFrame
    own: tuple[str, ...]
    inherited: tuple[str, ...]
    stats: bm25.CorpusStats
    lined: bool = False

    @staticmethod
    def build(children: DataFrame, parents: DataFrame, own: tuple[str, ...], inherited: tuple[str, ...],
              lined: bool = False) -> InheritedSearch:
        """With statistics as the children's own rows would have them, written once."""
        line = F.col("text") if lined else token_line(F.col("text"))
        each = bm25.field_rows(children, {f: f for f in own}).select("field", line.alias("line"), F.lit(1).cast("long").alias("n"))
        rows = bm25.field_rows(parents.withColumn("_id", F.struct("parent_id", "n_children")), {f: f for f in inherited}, "_id")
        shared = rows.select("field", token_line(F.col("text")).alias("line"), F.col("doc_id.n_children").alias("n"))
        terms = written_table(bm25.line_terms(each.unionByName(shared)))
        return InheritedSearch(children, parents, own, inherited, bm25.CorpusStats(written_table(bm25.field_stats(terms)), terms), lined)

    def search(self, queries: DataFrame, limits: dict[str, int]) -> DataFrame:
        """Top ``limits[field]`` children per (query, field), as ``bm25.search_fields`` on the children ranks them."""
        parts = []
        own, inherited = ({f: k for f, k in limits.items() if f in names} for names in (self.own, self.inherited))
        if own:
            rows = bm25.field_rows(self.children, {f: f for f in own})
            parts.append(bm25.search_fields(rows, queries, own, stats=self.stats, lined=self.lined))
        if inherited:
            rows = bm25.field_rows(self.parents, {f: f for f in inherited}, "parent_id")
            found = bm25.search_fields(rows, queries, inherited, stats=self.stats)
            found = checkpointed(found.select("query_id", "field", "score", F.col("doc_id").alias("parent_id")))
            below = lookup_join(found, self.children.select("doc_id", "parent_id"), "parent_id", few=is_few(found))
            parts.append(bm25.best_per_field(below.drop("parent_id"), inherited))
        columns = ("query_id", "field", "doc_id", "score", "rank")
        out = parts[0].select(*columns)
        for part in parts[1:]:
            out = out.unionByName(part.select(*columns))
        return out
