"""Tables whose versions are whole: changes of several tables become visible in one commit.

A table is dealt into buckets by the hash of its key.  A change rewrites only the buckets that
hold its keys; an append adds files.  What a version consists of stands in its manifest
(``sources/commits.py``), so a job that ends half-way changes nothing, an older version can
still be read, and of two competing changes the later one is made again on top of the first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweir.operators.relational import upsert
from corpusweir.session import bounded_broadcast
from corpusweir.sources.commits import CommitLog, Version

BUCKETS = 64


class Change:
    """Changes of one commit, made on top of ``base``; nothing is visible before it is published."""

    def __init__(self, store: Store, base: Version):
        self.store, self.base = store, base
        self.tables = {name: dict(files) for name, files in base.content.get("tables", {}).items()}

    def _bucket(self, name: str):
        return F.pmod(F.xxhash64(self.store.keys[name]), F.lit(self.store.buckets)).cast("int")

    def _written(self, name: str, rows: DataFrame) -> dict[str, str]:
        """Files of ``rows`` by bucket."""
        part = self.store.log.new_part()
        rows.withColumn("_bucket", self._bucket(name)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.store.log.path}/{part}")
        return {b.split("=")[1]: f"{part}/{b}" for b in self.store.log.folder.names(part) if b.startswith("_bucket=")}

    def _touched(self, name: str, rows: DataFrame) -> list[str]:
        """At most as many as there are buckets."""
        return sorted(str(r[0]) for r in rows.select(self._bucket(name)).distinct().collect())

    def read(self, name: str, buckets: list[str] | None = None) -> DataFrame:
        files = self.tables.get(name, {})
        return self.store.log.read([f for b, held in files.items() if buckets is None or b in buckets for f in held], self.store.schemas[name])

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows as they are."""
        kept = self.tables.setdefault(name, {})
        for bucket, file in self._written(name, rows.select(*self.store.columns(name))).items():
            kept[bucket] = [*kept.get(bucket, []), file]

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Rows replace those of their key, or are added."""
        rows = rows.select(*self.store.columns(name))
        touched = self._touched(name, rows)
        self._replace(name, touched, upsert(self.read(name, touched), rows, self.store.keys[name]))

    def delete(self, name: str, keys: DataFrame) -> None:
        """Rows go whose key is among ``keys``."""
        key = self.store.keys[name]
        keys = keys.select(key).filter(F.col(key).isNotNull()).distinct()
        touched = self._touched(name, keys)
        self._replace(name, touched, self.read(name, touched).join(bounded_broadcast(keys), key, "left_anti"))

    def _replace(self, name: str, touched: list[str], rows: DataFrame) -> None:
        kept = {b: f for b, f in self.tables.get(name, {}).items() if b not in touched}
        self.tables[name] = kept | {b: [f] for b, f in self._written(name, rows.select(*self.store.columns(name))).items()}


class Store:
    """Tables at ``path``: ``tables`` gives each one's schema and key."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, tuple[str, str]], buckets: int = BUCKETS):
        self.log, self.buckets = CommitLog(spark, path), buckets
        self.schemas = {name: schema for name, (schema, _) in tables.items()}
        self.keys = {name: key for name, (_, key) in tables.items()}

    def columns(self, name: str) -> list[str]:
        return self.log.read([], self.schemas[name]).columns

    def commit(self, work: Callable[[Change], None], note: str = "") -> Version:
        """Publishes all that ``work`` did to its ``Change`` at once; after a lost race it is done again."""

        def change(base: Version) -> dict:
            made = Change(self, base)
            work(made)
            return {"tables": made.tables, "note": note}

        return self.log.commit(change)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        at = self.log.latest() if version is None else self.log.version(version)
        return Change(self, at).read(name)


def migrate_into(store: Store, source: dict[str, DataFrame], histories: tuple[str, ...]) -> Version:
    """All tables in one commit: histories are appended, the others merged by key."""

    def work(change: Change) -> None:
        for name, rows in source.items():
            (change.append if name in histories else change.upsert)(name, rows)

    return store.commit(work, "migration")


def delete_documents(store: Store, ids: DataFrame, tables: tuple[str, ...] = ("documents", "chunks")) -> Version:
    """Documents with all that belongs to them, in one commit."""

    def work(change: Change) -> None:
        for name in tables:
            change.delete(name, ids)

    return store.commit(work, "delete documents")
