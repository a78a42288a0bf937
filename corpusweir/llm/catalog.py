"""The named queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweir.llm import (
    hadamard_clusters, learned_index, line_dedup, lz_fingerprint, mixing, neardup, packing, passages, secret_scan, sharding, spelling,
    toxicity, vector_links,
)
from corpusweir.llm.tokens import public_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

CAPACITY = 2048


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_duplicate_lines")
def op1_duplicate_lines(spark: SparkSession, sf: str) -> DataFrame:
    marks = line_dedup.duplicate_lines(table(spark, sf, "documents"))
    return marks.select("doc_id", "line_no", "first_id", "first_line", "kept")


def _spans_sql() -> str:
    """Positions of all matches, from the lengths of what lies between them."""
    base = {
        "assign": r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
        r"|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)",
        "access": r"AKIA[A-Z0-9]+",
        "hex": r"[0-9a-f]{32,}",
        "pem": r"-----BEGIN ((RSA|EC|DSA|OPENSSH|PGP|ENCRYPTED) )?PRIVATE KEY( BLOCK)?-+",
        "jwt": r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
        "github": r"gh[pousr]_[A-Za-z0-9]+",
        "slack": r"xox[abprs]-[A-Za-z0-9-]+",
        "google": r"AIza[0-9A-Za-z_-]+",
    }
    keep = {
        "assign": f"length(regexp_extract(m, '{base['assign']}', 2)) >= 8",
        "access": "length(m) >= 16",
        "hex": "true",
        "pem": "length(regexp_extract(m, '-+$')) >= 5",
        "jwt": "length(regexp_extract(m, '[^.]*$')) >= 10",
        "github": "length(m) >= 40",
        "slack": "length(m) >= 15",
        "google": "length(m) >= 39",
    }
    found = " UNION ALL ".join(
        f"SELECT doc_id, '{kind}' AS kind, {rank} AS nth, m, i, gaps, ms FROM (SELECT doc_id, "
        f"regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gaps FROM d), "
        f"unnest(ms) WITH ORDINALITY AS u(m, i) WHERE {keep[kind]}"
        for rank, (kind, pattern) in enumerate(base.items())
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
placed AS (
  SELECT doc_id, kind, nth, m, list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT
    + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s FROM found),
spans AS (SELECT doc_id, kind, nth, s, kind || ':' || s || ':' || (s + length(m)) AS span FROM placed),
summed AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY s, nth) FILTER (nth < 3) AS base,
    string_agg(span, ',' ORDER BY s, nth) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN summed USING (doc_id)"""


@query("op2_secret_spans", _spans_sql())
def op2_secret_spans(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secret_spans(table(spark, sf, "documents")))


@query("op3_learned_neighbours")
def op3_learned_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return learned_index.nearest_neighbours(table(spark, sf, "embeddings"))


OP4_SQL = """
WITH bytes AS (
  SELECT doc_id, source, coalesce(text, '') AS t, octet_length(encode(coalesce(text, '')))::BIGINT + 16 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents),
steps AS (SELECT list(c ORDER BY k) AS crc_of FROM (
  SELECT k, list_reduce(list_prepend(k, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM (SELECT unnest(range(256)) AS k))),
rows AS (
  SELECT doc_id, size, source, xor(list_reduce(list_prepend(4294967295, b),
    lambda c, x: xor(c >> 8, crc_of[xor(c & 255, x) + 1])), 4294967295)::BIGINT AS text_crc32 FROM bytes, steps),
keyed AS (SELECT *, md5('7|' || doc_id || '|' || text_crc32) AS k,
  CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS s FROM rows),
ranked AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY k, doc_id) AS r, count(*) OVER (PARTITION BY s) AS n FROM keyed),
laid AS (SELECT *, row_number() OVER (ORDER BY (2 * r - 1) / (2 * n), s, k, doc_id) - 1 AS p, count(*) OVER () AS total FROM ranked),
cut AS (SELECT *, (p * 40 // total)::INT AS shard FROM laid)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY p) - 1 AS slot,
  NULL::INT AS grown_shard FROM cut"""


@query("op4_interleaved_shards", OP4_SQL)
def op4_interleaved_shards(spark: SparkSession, sf: str) -> DataFrame:
    laid = sharding.interleaved_shards(table(spark, sf, "documents"))
    return laid.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op6_packed_sequences")
def op6_packed_sequences(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed_sequences(table(spark, sf, "documents"), public_path(), CAPACITY)


@query("op7_lz_fingerprints")
def op7_lz_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return lz_fingerprint.edited_likeness(table(spark, sf, "documents"))


@query("op8_repeated_passages")
def op8_repeated_passages(spark: SparkSession, sf: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf, "documents"))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
twoway AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT twoway.b, reach.r FROM reach JOIN twoway ON twoway.a = reach.d),
comp AS (SELECT d, min(r) AS c FROM reach GROUP BY d)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, comp.c AS component_id, comp.c = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN comp ON comp.d = d.doc_id"""


@query("op9_near_duplicates", OP9_SQL)
def op9_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    marks = neardup.near_duplicates(table(spark, sf, "documents"), neardup.WORD_PAIRS)
    return marks.select("doc_id", "n_shingles", "component_id", "kept")


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS s FROM documents),
src AS (SELECT s, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY s) AS k FROM d GROUP BY s),
w AS (SELECT s, n, ((k - 1) % 3 + 1)::DOUBLE AS w, 3 * n AS cap, 3 * n / ((k - 1) % 3 + 1) AS ratio FROM src),
lv AS (SELECT *, ((SELECT sum(n) FROM w)::DOUBLE - (sum(cap) OVER o - cap)) / ((SELECT sum(w) FROM w) - (sum(w) OVER o - w)) AS level
  FROM w WINDOW o AS (ORDER BY ratio, s ROWS UNBOUNDED PRECEDING)),
t AS (SELECT s, n, cap, CASE WHEN ratio > level THEN w * (SELECT min_by(level, (ratio, s)) FROM lv WHERE ratio > level)
  ELSE cap::DOUBLE END AS target FROM lv),
b AS (SELECT *, least(round(target)::BIGINT, cap) AS words FROM t),
x AS (SELECT d.*, b.n, b.target, b.words, CASE WHEN b.n > 0 THEN b.words // b.n ELSE 0 END AS whole,
  sum(size) OVER (PARTITION BY d.s ORDER BY md5('11|' || doc_id || '|' || size), doc_id ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN b ON b.s = d.s)
SELECT doc_id, size, n AS source_size, target,
  (whole * size + greatest(0, least(size, words - whole * n - before)))::BIGINT AS taken FROM x"""


@query("op10_mixed_sources", OP10_SQL)
def op10_mixed_sources(spark: SparkSession, sf: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


OP11_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS d, vec_id AS r FROM embeddings UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.d),
comp AS (SELECT d, min(r) AS c FROM reach GROUP BY d),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, c AS component_id, c = vec_id AS kept FROM embeddings JOIN comp ON d = vec_id LEFT JOIN n ON n.a = vec_id"""


@query("op11_vector_links", OP11_SQL)
def op11_vector_links(spark: SparkSession, sf: str) -> DataFrame:
    return vector_links.vector_links(table(spark, sf, "embeddings"))


OP12_SQL = """
WITH RECURSIVE steps AS (SELECT list(c ORDER BY k) AS crc_of FROM (
  SELECT k, list_reduce(list_prepend(k, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM (SELECT unnest(range(256)) AS k))),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
own AS (SELECT doc_id, r, count(*) AS c FROM runs WHERE length(r) >= 7 GROUP BY doc_id, r),
hashed AS (SELECT r, c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
    regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)), '..'), lambda x: ('0x' || x)::BIGINT)),
  lambda k, x: xor(k >> 8, crc_of[xor(k & 255, x) + 1])), 4294967295) AS h FROM own, steps),
made AS (SELECT c, CASE WHEN h % 31 = 0 THEN substring(r, 1, (h % length(r))::INT) || substring(r, (h % length(r))::INT + 2) ELSE r END AS word FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
less AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS d
  FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)),
shorter AS (SELECT DISTINCT l.word AS long, l.n AS long_n, w.word AS short, w.n AS short_n FROM less l JOIN words w ON w.word = l.d),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION ALL SELECT long, short, short_n FROM shorter UNION ALL SELECT short, long, long_n FROM shorter),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM near GROUP BY word),
marked AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form,
  CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best USING (word)),
path AS (SELECT word, word AS at FROM marked UNION ALL SELECT path.word, m.form FROM path JOIN marked m ON m.word = path.at WHERE m.form IS NOT NULL),
ends AS (SELECT path.word, path.at AS root FROM path JOIN marked m ON m.word = path.at WHERE m.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM marked JOIN ends USING (word)"""


@query("op12_spelling_variants", OP12_SQL)
def op12_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf, "documents"))


def _clusters_sql(k: int = 40, rounds: int = 5) -> str:
    """The rounds written out: components as rows, exact in integers."""
    parts = ["""
WITH kept AS (
  SELECT vec_id, embedding AS e FROM embeddings WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
v AS (SELECT vec_id, i, floor(256 * e[i]::DOUBLE)::BIGINT AS x FROM (SELECT vec_id, e, unnest(range(1, 65))::INT AS i FROM kept)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id), vec_id) - 1 AS c FROM kept),
c0 AS MATERIALIZED (SELECT c, i, x FROM first JOIN v USING (vec_id) WHERE c < """ + str(k) + ")"]
    for r in range(rounds + 1):
        parts.append(f"""
a{r} AS MATERIALIZED (SELECT vec_id, min(c) AS c, min(d) AS d FROM (
  SELECT vec_id, c, d, min(d) OVER (PARTITION BY vec_id) AS m FROM (
    SELECT vec_id, c, sum((v.x - k.x) * (v.x - k.x))::BIGINT AS d FROM v JOIN c{r} k USING (i) GROUP BY vec_id, c)) WHERE d = m GROUP BY vec_id)""")
        if r < rounds:
            parts.append(f"""
c{r + 1} AS MATERIALIZED (SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, k.x)::BIGINT AS x FROM c{r} k LEFT JOIN (
  SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM a{r} JOIN v USING (vec_id) GROUP BY c, i) USING (c, i))""")
    return ",".join(parts) + f"""
SELECT vec_id, a.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
FROM a{rounds} a JOIN (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c) USING (c)"""


@query("op13_progressive_clusters", _clusters_sql())
def op13_progressive_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return hadamard_clusters.progressive_clusters(table(spark, sf, "embeddings"))
