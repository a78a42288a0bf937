"""Document elements: extraction from HTML, typing, markers, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusweir import lexicon as L
from corpusweir.functions.text import computed, contains_any, strip

# Block tags and the element type they stand for (fixed values).
TAG_TYPES = {
    "title": "Title", "h1": "Title", "h2": "Title", "h3": "Title", "h4": "Title", "h5": "Title", "h6": "Title",
    "p": "NarrativeText", "li": "ListItem", "table": "Table", "header": "Header", "footer": "Footer",
}
BLOCK = r"(?is)<(" + "|".join(TAG_TYPES) + r")(?:\s[^>]*)?>.*?</\1>"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def without_code(html: Column) -> Column:
    """Scripts, styles and comments removed."""
    out = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>", " ")
    return F.regexp_replace(out, r"(?s)<!--.*?-->", " ")


def inner_text(markup: Column) -> Column:
    out = F.regexp_replace(markup, r"<[^>]*>", " ")
    for entity, char in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(out, r"\s+", " "))


def html_elements(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, position, type, text) of block elements in document order."""
    clean = computed(pages.select(key, html), {"_h": without_code(F.col(html))})
    blocks = clean.select(key, F.posexplode(F.regexp_extract_all("_h", F.lit(BLOCK), F.lit(0))).alias("position", "block"))
    tag = F.lower(F.regexp_extract("block", r"^<([a-zA-Z0-9]+)", 1))
    types = F.create_map(*[F.lit(x) for pair in TAG_TYPES.items() for x in pair])
    rows = blocks.select(key, F.col("position").cast("long").alias("position"), types[tag].alias("type"),
                         inner_text(F.col("block")).alias("text"))
    return rows.filter("text <> ''")


def classify(original: Column, content: Column) -> Column:
    """Finer element class from the type and the words of the content."""
    low = strip(F.lower(content))
    title = (
        F.when(contains_any(low, L.TITLE_DOCUMENT), "document_title")
        .when(contains_any(low, L.TITLE_SECTION), "section_title").otherwise("title")
    )
    narrative = (
        F.when(F.length(content) > 500, "main_content")
        .when(contains_any(low, L.NARRATIVE_AUTHOR), "author_info")
        .when(contains_any(low, L.NARRATIVE_KEYWORDS), "keywords").otherwise("narrative_text")
    )
    item = (
        F.when(content.rlike(r"^\p{Nd}+[\.\)]\s+"), "numbered_list")
        .when(content.rlike(r"^[•·\-\*]\s+"), "bullet_list").otherwise("list_item")
    )
    return (
        F.when(original == "Title", title).when(original == "NarrativeText", narrative)
        .when(original == "ListItem", item).otherwise(F.lower(original))
    )


# Marker of each element type, in the two notations.
MARKERS = {
    "title": "TITLE", "heading": "TITLE", "header": "HEADER", "narrativetext": "HEADER", "section": "SECTION",
    "table": "TABLE", "tabular": "TABLE", "list": "LIST", "listitem": "LIST",
    "figure_caption": "FIGURE_CAPTION", "footer": "FOOTER",
}


def marked(kind: Column, text: Column) -> Column:
    """Element text inside its structure marker."""
    out = F.when(F.lit(False), "")
    for name, tag in MARKERS.items():
        out = out.when(F.lower(kind) == name, F.concat(F.lit(f"<{tag}>"), text, F.lit(f"</{tag}>")))
    return out.otherwise(text)


def marked_documents(elements: DataFrame, key: str) -> DataFrame:
    """One text per document with structure markers, elements in order.

    The elements of one document are gathered; a document is one row everywhere
    else too, so this is bounded by the document, not by the data.
    """
    rows = elements.filter(strip(F.coalesce("text", F.lit(""))) != "")
    ordered = F.array_sort(F.collect_list(F.struct("position", marked(F.col("type"), strip(F.col("text"))).alias("m"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(ordered, lambda s: s["m"]), "\n\n").alias("text"))


def document_metadata(elements: DataFrame, key: str) -> DataFrame:
    """Counts, lengths, flags, types and the first title of every document."""
    kind = classify(F.col("type"), F.col("text"))
    rows = elements.withColumn("_kind", kind)
    is_title = F.col("_kind").isin("document_title", "title")
    return rows.groupBy(key).agg(
        F.count("*").alias("total_elements"), F.sum(F.length("text")).cast("long").alias("total_length"),
        F.bool_or(F.col("_kind") == "table").alias("has_tables"),
        F.array_join(F.array_sort(F.collect_set("_kind")), ",").alias("element_types"),
        F.count_distinct("_kind").alias("distinct_types"),
        F.substring(F.min_by(F.when(is_title, F.col("text")), F.when(is_title, F.col("position"))), 1, 100).alias("title"),
    )


def type_histogram(elements: DataFrame) -> DataFrame:
    kind = classify(F.col("type"), F.col("text"))
    return elements.groupBy(kind.alias("element_type")).agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("length"))


def text_pages(docs: DataFrame, key: str, text: str, lines: int = 40) -> DataFrame:
    """``key, page_number, start, end``: pages of so many lines, by character offsets (end exclusive).

    A document is one row, so its lines are numbered inside it.
    """
    each = docs.select(key, F.posexplode(F.split(text, "\n")).alias("_i", "_line"))
    of_document = Window.partitionBy(key).orderBy("page_number")
    pages = each.groupBy(key, (F.floor(F.col("_i") / lines) + 1).cast("int").alias("page_number")).agg(
        F.sum(F.length("_line") + 1).alias("_size")
    )
    return pages.withColumn("end", F.sum("_size").over(of_document)).select(
        key, "page_number", (F.col("end") - F.col("_size")).alias("start"), "end"
    )


def spanned_pages(chunks: DataFrame, pages: DataFrame, key: str, chunk: list[str], stretch: int = 4096) -> DataFrame:
    """First and last page and ``page_range`` of every chunk: ``chunks(key, *chunk, start, end)`` over ``pages(key, page_number, start, end)``.

    Both sides are cut into stretches of offsets and meet by (key, stretch): a range join
    without a nested loop, in which a long document is many keys.  A chunk that meets no page
    has none.
    """

    def cut(rows: DataFrame) -> DataFrame:
        last = F.greatest(F.col("end") - 1, F.col("start"))
        return rows.withColumn("_stretch", F.explode(F.sequence(F.floor(F.col("start") / stretch), F.floor(last / stretch))))

    left = cut(chunks.select(key, *chunk, "start", "end"))
    right = cut(pages.select(key, "page_number", F.col("start"), F.col("end"))).select(
        key, "_stretch", "page_number", F.col("start").alias("_from"), F.col("end").alias("_to")
    )
    met = left.join(right, [key, "_stretch"], "left").withColumn(
        "page_number", F.when((F.col("start") < F.col("_to")) & (F.col("_from") < F.col("end")), F.col("page_number"))
    )
    return met.groupBy(key, *chunk).agg(
        F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"),
        F.when(F.count("page_number") > 0, page_range(F.col("page_number"))).alias("page_range"),
    )


def page_range(pages: Column) -> Column:
    """'min-max' of the page numbers (an aggregate)."""
    return F.concat_ws("-", F.min(pages).cast("string"), F.max(pages).cast("string"))


def file_kind(path: Column) -> Column:
    """Document type from the file name."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    out = F.when(F.lit(False), "")
    for kind, words in L.FILE_KINDS:
        out = out.when(contains_any(name, words), kind)
    return out.otherwise("general_medical")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))


def is_supported(path: Column) -> Column:
    return extension(path).isin(*L.MIME_TYPES)


def mime_types(path: Column) -> Column:
    table = F.create_map(*[x for e, ms in L.MIME_TYPES.items() for x in (F.lit(e), F.array(*[F.lit(m) for m in ms]))])
    return F.coalesce(table[extension(path)], F.array().cast("array<string>"))


def size_in_bytes(text: Column) -> Column:
    """'10MB' -> bytes; a bare number is bytes."""
    n = F.regexp_extract(F.upper(text), r"^\s*(\d+)", 1).cast("long")
    unit = F.regexp_extract(F.upper(text), r"([KMG]?)B?\s*$", 1)
    return n * F.when(unit == "K", 1024).when(unit == "M", 1024 ** 2).when(unit == "G", 1024 ** 3).otherwise(1)


def upload_problem(path: Column, size: Column, mime: Column, limit: Column) -> Column:
    """Why an upload is refused; null when it is fine."""
    allowed = mime_types(path)
    return (
        F.when(size > limit, "file too large")
        .when(~is_supported(path), "unsupported format")
        .when((F.size(allowed) > 0) & ~F.array_contains(allowed, mime), "type does not match the extension")
    )


def table_text(rows: Column) -> Column:
    """Table rows (array of arrays) as lines with cells joined by ' | '; empty cells stay empty."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(
        r, lambda c: F.coalesce(c, F.lit(""))), " | ")), "\n")
