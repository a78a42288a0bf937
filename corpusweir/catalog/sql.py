"""SQL fragments shared by the checking statements."""

from __future__ import annotations

from corpusweir.functions.text import WS

K1, B, EPS = 1.5, 0.75, 0.25


def tok(col: str) -> str:
    return rf"list_filter(string_split_regex(lower({col}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def words(col: str) -> str:
    return f"list_filter(string_split_regex({col}, '{WS}+'), lambda x: x <> '')"


def strip(col: str) -> str:
    return f"regexp_replace({col}, '^{WS}+|{WS}+$', '', 'g')"


def snippet(col: str, n: int) -> str:
    return f"CASE WHEN length({col}) > {n} THEN substr({col}, 1, {n}) || '...' ELSE {col} END"


def cos(a: str, b: str) -> str:
    a, b = f"{a}::DOUBLE[]", f"{b}::DOUBLE[]"
    return (f"list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * "
            f"sqrt(list_dot_product({b}, {b})))")


# Whole documents with the synthesised keyword and summary fields.
DOC_FIELDS = f"""
 src AS (SELECT doc_id,
   concat_ws(' ', list_aggregate({words('source')}[1:5], 'string_agg', ' '),
                  list_aggregate({words('text')}[1:10], 'string_agg', ' ')) AS keywords,
   {snippet('text', 200)} AS summary, text AS content FROM documents),
 rws AS (SELECT doc_id, 'keywords' AS field, keywords AS text FROM src
   UNION ALL SELECT doc_id, 'summary', summary FROM src
   UNION ALL SELECT doc_id, 'content', content FROM src)"""

_LONGER = f"list_filter({tok('content')}, lambda x: length(x) > 3)"

# Fixed windows: parents of 1024 characters, children of 256.  Keywords are the parent's
# eight most frequent words of more than three letters, the first occurrence breaks ties.
CHUNKS = f"""
 par AS (SELECT doc_id, i AS parent_index, doc_id || '-' || i AS parent_id,
   substr(text, i * 1024 + 1, 1024) AS content
   FROM (SELECT doc_id, text, unnest(range(0, ceil(length(text) / 1024.0)::BIGINT)) AS i FROM documents)),
 kwc AS (SELECT parent_id, term, count(*) AS n, min(pos) AS pos FROM (SELECT parent_id, unnest({_LONGER}) AS term,
   generate_subscripts({_LONGER}, 1) AS pos FROM par) GROUP BY ALL),
 kwr AS (SELECT parent_id, term, row_number() OVER (PARTITION BY parent_id ORDER BY n DESC, pos) AS r FROM kwc QUALIFY r <= 8),
 kwl AS (SELECT parent_id, string_agg(term, ' ' ORDER BY r) AS keywords FROM kwr GROUP BY parent_id),
 parent AS (SELECT par.*, coalesce(keywords, '') AS keywords, CASE WHEN len({words('content')}) > 0 THEN {snippet('content', 200)}
   ELSE '文档片段 ' || (parent_index + 1) END AS summary FROM par LEFT JOIN kwl USING (parent_id)),
 child AS (SELECT doc_id, parent_id, parent_id || '-' || j AS chunk_id, j AS child_index,
   substr(content, j * 256 + 1, 256) AS content, keywords, summary
   FROM (SELECT *, unnest(range(0, ceil(length(content) / 256.0)::BIGINT)) AS j FROM parent))"""

CHILD_FIELDS = CHUNKS + """,
 rws AS (SELECT chunk_id AS doc_id, 'keywords' AS field, coalesce(keywords, '') AS text FROM child
   UNION ALL SELECT chunk_id, 'summary', summary FROM child
   UNION ALL SELECT chunk_id, 'content', content FROM child)"""

QUERY_SET = " qry AS (SELECT item_id AS query_id, text FROM benchmark)"


def bm25(limits: str = "50", queries: str = QUERY_SET) -> str:
    """CTEs over ``rws(doc_id, field, text)`` ending in ``rk`` (ranked positive scores)."""
    return f"""{queries},
 qt AS (SELECT query_id, term, count(*) AS qtf FROM
   (SELECT query_id, unnest({tok('text')}) AS term FROM qry) GROUP BY ALL),
 tk AS (SELECT field, doc_id, {tok('text')} AS terms FROM rws),
 st AS (SELECT field, count(*) AS n_docs, avg(len(terms)) AS avgdl FROM tk GROUP BY field),
 tf AS (SELECT field, doc_id, dl, term, count(*) AS tf FROM
   (SELECT field, doc_id, len(terms) AS dl, unnest(terms) AS term FROM tk) GROUP BY ALL),
 df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
 ri AS (SELECT field, term, avgdl, ln((n_docs - df + 0.5) / (df + 0.5)) AS idf FROM df JOIN st USING (field)),
 mi AS (SELECT field, avg(idf) AS mean_idf FROM ri GROUP BY field),
 wi AS (SELECT field, term, avgdl, CASE WHEN idf < 0 THEN {EPS} * mean_idf ELSE idf END AS idf
   FROM ri JOIN mi USING (field)),
 sc AS (SELECT query_id, field, doc_id,
   round(sum(qtf * idf * (tf * {K1 + 1}) / (tf + {K1} * (1 - {B} + {B} * dl / avgdl))), 9) AS score
   FROM tf JOIN wi USING (field, term) JOIN qt USING (term) GROUP BY ALL),
 rk0 AS (SELECT *, row_number() OVER (PARTITION BY query_id, field ORDER BY score DESC, doc_id) AS rank
   FROM sc WHERE score > 0),
 rk AS (SELECT * FROM rk0 WHERE rank <= {limits})"""


PATH_LIMITS = "CASE field WHEN 'keywords' THEN 30 ELSE 20 END"

VECTOR = f"""
 qv AS (SELECT item_id AS query_id, embedding FROM benchmark JOIN embeddings ON vec_id = item_id),
 vs AS (SELECT query_id, vec_id AS doc_id, round({cos('e.embedding', 'qv.embedding')}, 9) AS score
   FROM embeddings e, qv),
 vk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM vs
   QUALIFY rank <= 50)"""

# Four ranked lists over whole documents.
DOC_LISTS = (
    DOC_FIELDS + "," + bm25(PATH_LIMITS) + "," + VECTOR + """,
 lists AS (SELECT query_id, field AS path, rank, doc_id, score FROM rk
   UNION ALL SELECT query_id, 'vector', rank, doc_id, score FROM vk),
 wts AS (SELECT * FROM (VALUES ('vector', 0.4), ('keywords', 0.3), ('summary', 0.2), ('content', 0.1)) w(path, weight)),
 nrm AS (SELECT *, CASE WHEN count(*) OVER w = 1 THEN score
     WHEN max(score) OVER w = min(score) OVER w THEN 1.0
     ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm
   FROM lists JOIN wts USING (path) WINDOW w AS (PARTITION BY query_id, path))"""
)



def _hashed(name: str, key: str, text: str, source: str) -> str:
    """Signed counts of a text's tokens in 64 places, by md5."""
    return f""" {name} AS (SELECT {key}, ('0x' || substr(md5(term), 1, 4))::BIGINT % 64 AS place,
   sum(CASE WHEN ('0x' || substr(md5(term), 5, 1))::BIGINT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v
   FROM (SELECT {key}, unnest({tok(text)}) AS term FROM {source}) GROUP BY ALL HAVING v <> 0),
 {name}n AS (SELECT {key}, sqrt(sum(v * v)) AS norm FROM {name} GROUP BY {key})"""


# Every child and every query has a vector of its own words.
CHILD_VECTOR = _hashed("cv", "chunk_id", "content", "child") + "," + _hashed("qhv", "query_id", "text", "qry") + """,
 vs AS (SELECT query_id, chunk_id AS doc_id, round(any_value(dot) / (any_value(a.norm) * any_value(b.norm)), 9) AS score
   FROM (SELECT query_id, chunk_id, sum(cv.v * qhv.v) AS dot FROM cv JOIN qhv USING (place) GROUP BY ALL)
   JOIN cvn a USING (chunk_id) JOIN qhvn b USING (query_id) GROUP BY ALL),
 vk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM vs QUALIFY rank <= 50)"""



def child_lists(queries: str = QUERY_SET, name: str = "lists") -> str:
    """Four ranked lists over children for the queries of ``qry``."""
    return CHILD_FIELDS + "," + bm25(PATH_LIMITS, queries) + "," + CHILD_VECTOR + f""",
 {name} AS (SELECT query_id, field AS path, rank, rk.doc_id, parent_id, score
     FROM rk JOIN child ON chunk_id = rk.doc_id
   UNION ALL SELECT query_id, 'vector', rank, vk.doc_id, parent_id, score
     FROM vk JOIN child ON chunk_id = vk.doc_id)"""


DEDUP = """,
 ddp AS (SELECT query_id, path, doc_id, parent_id, score,
   row_number() OVER (PARTITION BY query_id, path ORDER BY rank) AS rank
   FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path, parent_id ORDER BY rank) AS nth FROM lists)
   WHERE nth = 1 OR parent_id IS NULL)"""

CHILD_LISTS = child_lists() + DEDUP

FUSION = """,
 wts AS (SELECT * FROM (VALUES ('vector', 0.4), ('keywords', 0.3), ('summary', 0.2), ('content', 0.1)) w(path, weight)),
 fus AS (SELECT query_id, doc_id, round(sum(weight / (60 + rank)), 9) AS fusion_score
   FROM ddp JOIN wts USING (path) GROUP BY ALL),
 fk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, doc_id) AS fusion_rank
   FROM fus QUALIFY fusion_rank <= 40),
 scr AS (SELECT query_id, doc_id, any_value(parent_id) AS parent_id,
   max(CASE WHEN path <> 'vector' THEN score END) AS bm25_score,
   max(CASE WHEN path = 'vector' THEN score END) AS similarity_score FROM ddp GROUP BY ALL),
 cnd AS (SELECT * FROM fk JOIN scr USING (query_id, doc_id)),
 rr AS (SELECT *, round((0.4 * fusion_score + coalesce(0.3 * bm25_score, 0) + coalesce(0.2 * similarity_score, 0))
     / (0.4 + CASE WHEN bm25_score IS NOT NULL THEN 0.3 ELSE 0 END
            + CASE WHEN similarity_score IS NOT NULL THEN 0.2 ELSE 0 END), 9) AS fused_rerank_score
   FROM cnd WHERE fusion_rank <= 10),
 rrk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_rerank_score DESC, doc_id) AS rank
   FROM rr)"""

FUSED = CHILD_LISTS + FUSION


def _literal(s: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in s)


def packed(name: str, source: str, key: str, text: str, size: int, overlap: int, separators) -> str:
    """CTEs that end in ``name(key, idx, content)``: separators split what is too long, then whole
    pieces are packed, one step of the recursion per chunk (``e`` holds the pieces' ends)."""
    mark, parts = "chr(57344)", f"[{text}]"
    for s in separators:
        cut = f"string_split(replace(p, {_literal(s)}, {mark} || {_literal(s)} || {mark}), {mark})"
        parts = f"flatten(list_transform({parts}, lambda p: CASE WHEN length(p) > {size} THEN {cut} ELSE [p] END))"
    stop = "e[last]"
    start = f"CASE WHEN {overlap} > 0 AND {stop} - s > {overlap} THEN {stop} - {overlap} ELSE {stop} END"
    fits = f"len(list_filter(e, lambda x: x <= {{}} + {size}))"
    return f"""
 {name}_p AS (SELECT {key}, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM (SELECT {key}, {parts} AS parts FROM {source} WHERE length({text}) > {size})),
 {name}_e AS (SELECT {key}, list(b::BIGINT ORDER BY i) AS e FROM (SELECT {key}, i, sum(length(p)) OVER (PARTITION BY {key} ORDER BY i) AS b FROM {name}_p) GROUP BY {key}),
 {name}_c AS (SELECT {key}, e, 0::BIGINT AS n, 0::BIGINT AS s, greatest(1, {fits.format(0)})::BIGINT AS last FROM {name}_e
  UNION ALL SELECT {key}, e, n + 1, t, greatest(last + 1, {fits.format('t')})::BIGINT FROM (SELECT *, {start} AS t FROM {name}_c) WHERE last < len(e)),
 {name}_t AS (SELECT {key}, n, {strip(f'substr({text}, s + 1, {stop} - s)')} AS content FROM {name}_c JOIN {source} USING ({key})
  UNION ALL SELECT {key}, 0, {text} FROM {source} WHERE length({text}) <= {size}),
 {name} AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY n) - 1 AS idx, content FROM {name}_t WHERE content <> '')"""
