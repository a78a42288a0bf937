"""Chunkers, elements, ingestion and staged retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusweir import lexicon as L
from corpusweir.catalog import clinical as K
from corpusweir.catalog import sql as S
from corpusweir.catalog.fixtures import chunk_corpus, chunk_queries
from corpusweir.catalog.registry import query, table, texts
from corpusweir.operators import chunking, elements
from corpusweir.plans import ingest as ingestion
from corpusweir.plans.progressive import STAGES, retrieve_progressive


def documents(spark, sf):
    return texts(spark, sf).select("doc_id", "text")


@query("fixed_chunks", "WITH " + S.CHUNKS + " SELECT chunk_id, parent_id, child_index, md5(content) AS content_md5 FROM child")
def fixed_chunks(spark, sf):
    children = chunking.fixed_children(chunking.fixed_parents(documents(spark, sf)))
    return children.select("chunk_id", "parent_id", "child_index", F.md5("content").alias("content_md5"))


@query("chunk_sentences", f"""WITH RECURSIVE c AS (
  SELECT doc_id, text, 0::BIGINT AS s, 0::BIGINT AS e FROM documents WHERE text <> ''
  UNION ALL
  SELECT doc_id, text, st, CASE WHEN st + 1000 < length(text) AND regexp_matches(substr(text, st + 901, least(150, length(text) - st - 900)), '[.!?。！？]')
    THEN st + 900 + length(regexp_extract(substr(text, st + 901, least(150, length(text) - st - 900)), '(?s)^(.*[.!?。！？])', 1))
    ELSE st + 1000 END
  FROM (SELECT doc_id, text, greatest(s + 800, e) AS st, e AS pe FROM c WHERE e < length(text) AND e > 0
    UNION ALL SELECT doc_id, text, 0, 0 FROM c WHERE e = 0) WHERE st < length(text)),
 k AS (SELECT doc_id, s, {S.strip('substr(text, s + 1, e - s)')} AS t FROM c WHERE e > 0)
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_index, md5(t) AS content_md5 FROM k WHERE t <> ''""")
def chunk_sentences(spark, sf):
    out = chunking.split_rows(documents(spark, sf), chunking.cut_sentences)
    return out.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("content").alias("content_md5"))


def _rfind(sep: str) -> str:
    chars = " || ".join(f"chr({ord(c)})" for c in sep)
    back = " || ".join(f"chr({ord(c)})" for c in reversed(sep))
    del chars
    return f"CASE WHEN instr(reverse(w), {back}) > 0 THEN length(w) - instr(reverse(w), {back}) + 1 ELSE 0 END"


_CUTS = ", ".join(f"{_rfind(s)} AS c{i}" for i, s in enumerate(chunking.HYBRID_SEPARATORS))
_PICK = " ".join(f"WHEN c{i} >= 100 + {len(s)} THEN c{i}" for i, s in enumerate(chunking.HYBRID_SEPARATORS))


@query("chunk_recursive", f"""WITH RECURSIVE c AS (
  SELECT doc_id, text, 0::BIGINT AS s, NULL::VARCHAR AS part, 0::BIGINT AS n, length(text) > 0 AS more FROM documents
  UNION ALL
  SELECT doc_id, text, CASE WHEN length(text) - s > 1000 THEN s + CASE WHEN cut > 200 THEN cut - 200 ELSE cut END ELSE s END,
   CASE WHEN length(text) - s > 1000 THEN substr(text, s + 1, cut) ELSE substr(text, s + 1) END, n + 1, length(text) - s > 1000
  FROM (SELECT *, CASE {_PICK} ELSE 1000 END::BIGINT AS cut FROM (SELECT *, {_CUTS} FROM
    (SELECT doc_id, text, s, n, substr(text, s + 1, 1200) AS w FROM c WHERE more)))),
 k AS (SELECT doc_id, n, {S.strip('part')} AS t FROM c WHERE n > 0),
 p AS (SELECT *, lag(t) OVER (PARTITION BY doc_id ORDER BY n) AS before FROM k WHERE t <> '')
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS chunk_index, md5(t) AS content_md5
 FROM p WHERE length(t) >= 100 OR before IS NULL OR NOT suffix(before, t)""")
def chunk_recursive(spark, sf):
    out = chunking.split_rows(documents(spark, sf), lambda t: chunking.cut_hybrid(t, similarity=None))
    return out.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("content").alias("content_md5"))


@query("chunk_hybrid")
def chunk_hybrid(spark, sf):
    out = chunking.split_rows(documents(spark, sf), chunking.cut_hybrid)
    return out.select("doc_id", "chunk_index", F.length("content").alias("n"))


_PACKED = S.packed("k", "documents", "doc_id", "text", 1000, 200, chunking.SEPARATORS)


@query("chunk_packed", f"WITH RECURSIVE {_PACKED} SELECT doc_id, idx AS chunk_index, md5(content) AS content_md5 FROM k")
def chunk_packed(spark, sf):
    out = chunking.split_rows(documents(spark, sf), lambda t: chunking.pack(t, 1000, 200))
    return out.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("content").alias("content_md5"))


@query("typed_chunks", f"""WITH RECURSIVE {_PACKED}
 SELECT doc_id, 'text' AS chunk_type, idx AS chunk_index, md5(content) AS content_md5 FROM k
 UNION ALL SELECT doc_id, 'table', 0, md5(lang) FROM documents UNION ALL SELECT doc_id, 'reference', 0, md5(source) FROM documents""")
def typed_chunks(spark, sf):
    docs = texts(spark, sf).select("doc_id", F.col("source").alias("filename"), "text",
                                   F.array("lang").alias("tables"), F.array("source").alias("references"))
    out = chunking.typed_chunks(docs, lambda t: chunking.pack(t, 1000, 200))
    return out.select("doc_id", "chunk_type", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("content").alias("content_md5"))


_PARENTS = S.packed("par", "documents", "doc_id", "text", chunking.PARENT_SIZE, chunking.PARENT_OVERLAP, chunking.SEPARATORS)
_CHILDREN = S.packed("chi", "pid", "parent_id", "content", chunking.CHILD_SIZE, chunking.CHILD_OVERLAP, chunking.SEPARATORS)


@query("small_to_big_split", f"""WITH RECURSIVE {_PARENTS},
 pid AS (SELECT doc_id || '-' || idx AS parent_id, idx AS parent_index, content FROM par), {_CHILDREN}
 SELECT parent_id || '-' || chi.idx AS chunk_id, parent_id, parent_index, chi.idx AS child_index, md5(chi.content) AS content_md5,
  length(chi.content) AS end_char, md5(pid.content) AS parent_md5 FROM chi JOIN pid USING (parent_id)""")
def small_to_big_split(spark, sf):
    parents, children = chunking.small_to_big(documents(spark, sf))
    whole = parents.select("parent_id", "parent_index", F.md5("content").alias("parent_md5"))
    return children.join(whole, "parent_id").select(
        "chunk_id", "parent_id", "parent_index", "child_index", F.md5("content").alias("content_md5"),
        F.col("end_char").cast("long").alias("end_char"), "parent_md5")


_SHORT = [e for e in L.CLEANER_ABBREVIATIONS.items() if e[0] != e[1]]
_CLEANED = f"""{K.TEXTS}, {K.without_noise('n', 't0')}, {K.without_headers('h', 'n')}, {K.replaced('x', 'h', _SHORT)},
 {K.without_repeats('r', 'x')}, {K.without_noise('m', 'r')},
 cl AS MATERIALIZED (SELECT doc_id, {K.collapsed('m.text')} AS text FROM m JOIN r USING (doc_id) WHERE {S.strip('r.text')} <> '')"""
_INGESTED = f"""{_CLEANED},
 {S.packed("par", "cl", "doc_id", "text", chunking.PARENT_SIZE, chunking.PARENT_OVERLAP, chunking.SEPARATORS)},
 pid AS MATERIALIZED (SELECT doc_id, doc_id || '-' || idx AS parent_id, idx AS parent_index, content FROM par), {_CHILDREN},
 kwc AS (SELECT parent_id, term, count(*) AS n, min(pos) AS pos FROM (SELECT parent_id, unnest({S._LONGER}) AS term,
   generate_subscripts({S._LONGER}, 1) AS pos FROM pid) GROUP BY ALL),
 kwr AS (SELECT parent_id, term, row_number() OVER (PARTITION BY parent_id ORDER BY n DESC, pos) AS r FROM kwc QUALIFY r <= 8),
 kwl AS (SELECT parent_id, string_agg(term, ' ' ORDER BY r) AS keywords FROM kwr GROUP BY parent_id)"""


@query("ingest_documents", f"""WITH RECURSIVE {_INGESTED}
 SELECT parent_id, md5(pid.content) AS content_md5, chi.idx AS child_index, md5(chi.content) AS child_md5, coalesce(keywords, '') AS keywords,
  CASE WHEN len({S.words('pid.content')}) > 0 THEN {S.snippet('pid.content', 200)} ELSE '文档片段 ' || (parent_index + 1) END AS summary
 FROM pid JOIN chi USING (parent_id) LEFT JOIN kwl USING (parent_id)""")
def ingest_documents(spark, sf):
    """Every child of cleaned texts with its parent and what it inherits."""
    done = ingestion.ingest(K.clinical(spark, sf))
    parents = done.parents.select("parent_id", F.md5("content").alias("content_md5"))
    return done.children.join(parents, "parent_id").select(
        "parent_id", "content_md5", "child_index", F.md5("content").alias("child_md5"), F.array_join("keywords", " ").alias("keywords"), "summary")


@query("ingest_metadata", f"""WITH RECURSIVE {_INGESTED}
 SELECT doc_id, count(*) AS total_chunks, sum(length(content))::BIGINT AS total_chars FROM pid GROUP BY doc_id""")
def ingest_metadata(spark, sf):
    return ingestion.final_metadata(ingestion.ingest(K.clinical(spark, sf)))


# ---------------------------------------------------------------------------- elements

_TAGS = "title h1 h2 h3 h4 h5 h6 p li table header footer".split()
_BLOCKS = "(?is)" + "|".join(rf"<{t}(?:\s[^>]*)?>.*?</{t}>" for t in _TAGS)
_EL = rf"""WITH h AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'),
   '(?s)<!--.*?-->', ' ', 'g') AS h FROM pages),
 b AS (SELECT page_id, unnest(regexp_extract_all(h, '{_BLOCKS}')) AS block,
   generate_subscripts(regexp_extract_all(h, '{_BLOCKS}'), 1) - 1 AS position FROM h),
 e0 AS (SELECT page_id, position, lower(regexp_extract(block, '^<([a-zA-Z0-9]+)', 1)) AS tag, regexp_replace(block, '<[^>]*>', ' ', 'g') AS t FROM b),
 e AS (SELECT page_id, position, CASE WHEN tag IN ('title', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6') THEN 'Title' WHEN tag = 'p' THEN 'NarrativeText'
   WHEN tag = 'li' THEN 'ListItem' WHEN tag = 'table' THEN 'Table' WHEN tag = 'header' THEN 'Header' ELSE 'Footer' END AS type,
   {S.strip("regexp_replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '[\\s\\x{0b}]+', ' ', 'g')")} AS text FROM e0),
 el AS (SELECT * FROM e WHERE text <> ''),
 kd AS (SELECT *, CASE type WHEN 'Title' THEN CASE WHEN contains(lower(text), 'abstract') THEN 'section_title' ELSE 'title' END
   WHEN 'NarrativeText' THEN CASE WHEN length(text) > 500 THEN 'main_content' WHEN contains(lower(text), 'author')
     OR contains(lower(text), 'corresponding') THEN 'author_info' WHEN contains(lower(text), 'keywords') OR contains(lower(text), 'key words')
     THEN 'keywords' ELSE 'narrative_text' END
   WHEN 'ListItem' THEN CASE WHEN regexp_matches(text, '^\p{{Nd}}+[\.\)]\s+') THEN 'numbered_list'
     WHEN regexp_matches(text, '^[•·\-\*]\s+') THEN 'bullet_list' ELSE 'list_item' END ELSE lower(type) END AS kind FROM el)"""


def page_elements(spark, sf):
    return elements.html_elements(texts(spark, sf, "pages", "page_id"))


@query("html_elements", _EL + " SELECT page_id, position, type, kind, md5(text) AS text_md5 FROM kd")
def html_elements(spark, sf):
    return page_elements(spark, sf).select(
        "page_id", "position", "type", elements.classify(F.col("type"), F.col("text")).alias("kind"),
        F.md5("text").alias("text_md5"))


@query("element_types", _EL + " SELECT kind AS element_type, count(*) AS n, sum(length(text))::BIGINT AS length FROM kd GROUP BY kind")
def element_types(spark, sf):
    return elements.type_histogram(page_elements(spark, sf))


@query("page_metadata", _EL + """
 SELECT page_id, count(*) AS total_elements, sum(length(text))::BIGINT AS total_length, bool_or(kind = 'table') AS has_tables,
  (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT DISTINCT kind AS k FROM kd i WHERE i.page_id = kd.page_id)) AS element_types,
  count(DISTINCT kind) AS distinct_types, substr(min_by(text, position) FILTER (kind = 'title'), 1, 100) AS title FROM kd GROUP BY page_id""")
def page_metadata(spark, sf):
    return elements.document_metadata(page_elements(spark, sf), "page_id")


_PG = r"""ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
 ps AS (SELECT doc_id, (i // 40 + 1)::INT AS page_number, sum(length(line) + 1) AS size FROM ln GROUP BY ALL),
 pg AS (SELECT doc_id, page_number, sum(size) OVER w - size AS s, sum(size) OVER w AS e FROM ps WINDOW w AS (PARTITION BY doc_id ORDER BY page_number)),
 ck AS (SELECT child.doc_id, chunk_id, parent_index * 1024 + child_index * 256 AS s, parent_index * 1024 + child_index * 256 + length(child.content) AS e
   FROM child JOIN parent USING (parent_id)),
 al AS (SELECT doc_id, chunk_id, s, e FROM ck UNION ALL SELECT doc_id, 'document', 0, max(e) FROM ck GROUP BY doc_id)"""


@query("page_ranges", "WITH " + S.CHUNKS + "," + _PG + """
 SELECT al.doc_id, chunk_id, min(page_number) AS first_page, max(page_number) AS last_page, min(page_number) || '-' || max(page_number) AS page_range
 FROM al JOIN pg ON pg.doc_id = al.doc_id AND al.s < pg.e AND pg.s < al.e GROUP BY ALL""")
def page_ranges(spark, sf):
    """The pages of every chunk and of every document as a whole."""
    docs = documents(spark, sf)
    pages = elements.text_pages(docs, "doc_id", "text")
    children = chunking.fixed_children(chunking.fixed_parents(docs))
    start = (F.split_part("parent_id", F.lit("-"), F.lit(2)).cast("long") * 1024 + F.col("child_index") * 256).alias("start")
    chunks = children.select("doc_id", "chunk_id", start, (start + F.length("content")).alias("end"))
    whole = chunks.groupBy("doc_id").agg(F.lit("document").alias("chunk_id"), F.lit(0).cast("long").alias("start"), F.max("end").alias("end"))
    return elements.spanned_pages(chunks.unionByName(whole), pages, "doc_id", ["chunk_id"])


@query("marked_pages", _EL + """
 SELECT page_id, md5(string_agg(CASE type WHEN 'Title' THEN '<TITLE>' || text || '</TITLE>' WHEN 'NarrativeText' THEN '<HEADER>' || text || '</HEADER>'
  WHEN 'ListItem' THEN '<LIST>' || text || '</LIST>' WHEN 'Table' THEN '<TABLE>' || text || '</TABLE>' WHEN 'Header' THEN '<HEADER>' || text || '</HEADER>'
  ELSE '<FOOTER>' || text || '</FOOTER>' END, chr(10) || chr(10) ORDER BY position)) AS text_md5 FROM kd GROUP BY page_id""")
def marked_pages(spark, sf):
    out = elements.marked_documents(page_elements(spark, sf), "page_id")
    return out.select("page_id", F.md5("text").alias("text_md5"))


@query("element_chunks", _EL + """
 SELECT page_id, position, CASE WHEN type = 'Table' THEN 'table' WHEN type IN ('Title', 'Header') THEN 'title'
  WHEN type = 'ListItem' THEN 'list' ELSE 'text' END AS chunk_type FROM kd""")
def element_chunks(spark, sf):
    out = chunking.element_chunks(page_elements(spark, sf).withColumnRenamed("page_id", "doc_id"))
    return out.select(F.col("doc_id").alias("page_id"), "position", "chunk_type")


@query("file_kinds", r"""SELECT page_id, CASE WHEN contains(n, 'report') THEN 'medical_report' WHEN contains(n, 'guideline') THEN 'clinical_guideline'
  WHEN contains(n, 'paper') THEN 'research_paper' ELSE 'general_medical' END AS kind, lower(regexp_extract(url, '(\.[A-Za-z0-9]+)$', 1)) AS extension,
  lower(regexp_extract(url, '(\.[A-Za-z0-9]+)$', 1)) IN ('.pdf', '.docx', '.pptx', '.xlsx', '.txt', '.md') AS supported
 FROM (SELECT *, lower(string_split(url, '/')[-1]) AS n FROM pages)""")
def file_kinds(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", elements.file_kind(url).alias("kind"),
                                            elements.extension(url).alias("extension"), elements.is_supported(url).alias("supported"))


@query("upload_checks", """SELECT doc_id, CASE WHEN n_chars > 2048 THEN 'file too large' WHEN lang = 'de' THEN 'unsupported format'
  WHEN lang = 'fr' THEN 'type does not match the extension' END AS problem FROM documents""")
def upload_checks(spark, sf):
    docs = table(spark, sf, "documents")
    name = F.concat(F.col("source"), F.when(F.col("lang") == "de", ".exe").otherwise(".txt"))
    mime = F.when(F.col("lang") == "fr", "application/pdf").otherwise("text/plain")
    return docs.select("doc_id", elements.upload_problem(
        name, F.col("n_chars"), mime, elements.size_in_bytes(F.lit("2KB"))).alias("problem"))


# ------------------------------------------------------------------- staged retrieval


@query("progressive_retrieval")
def progressive_retrieval(spark, sf):
    out = retrieve_progressive(chunk_corpus(spark, sf), chunk_queries(spark, sf), top=10)
    return out.select("query_id", "stage", "rank", "doc_id", F.round("fusion_score", 6).alias("fusion_score"),
                      F.round("quality", 6).alias("quality"))


@query("progressive_first_stage_only")
def progressive_first_stage_only(spark, sf):
    out = retrieve_progressive(chunk_corpus(spark, sf), chunk_queries(spark, sf), top=10, max_stage="standard",
                               stages=STAGES)
    return out.groupBy("stage").agg(F.count_distinct("query_id").alias("queries"))
