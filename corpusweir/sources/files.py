"""Files to elements: one row per file in, many element rows out.

Spark lists, splits and schedules the files (``binaryFile`` or ``wholetext``);
the parser of one file is a small function over its bytes.  PDF needs an
optional parser package; without it such files come out as rejects, not as
silent empties.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Element = tuple[str, str, int | None]  # type, text, page

SCHEMA = "path string, position long, type string, text string, page_number long, error string"


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of every file below ``path``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files, one value each."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(archive.read(name))


def _texts(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")


def parse_text(data: bytes) -> Iterator[Element]:
    yield "NarrativeText", data.decode("utf-8"), None


def parse_markdown(data: bytes) -> Iterator[Element]:
    for block in re.split(r"\n\s*\n", data.decode("utf-8")):
        lines = block.strip().split("\n")
        if not lines[0]:
            continue
        if lines[0].startswith("#"):
            yield "Title", lines[0].lstrip("# ").strip(), None
            lines = lines[1:]
        if all(line.lstrip().startswith("|") for line in lines) and lines:
            yield "Table", "\n".join(lines), None
        elif all(re.match(r"\s*([-*+•]|\d+[.)])\s+", line) for line in lines) and lines:
            for line in lines:
                yield "ListItem", line.strip(), None
        elif lines:
            yield "NarrativeText", "\n".join(lines).strip(), None


def parse_docx(data: bytes) -> Iterator[Element]:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = next(n for n in _xml(archive, "word/document.xml").iter() if _local(n.tag) == "body")
    for node in body:
        kind = _local(node.tag)
        if kind == "tbl":
            rows = [" | ".join(_texts(c) for c in r if _local(c.tag) == "tc") for r in node if _local(r.tag) == "tr"]
            yield "Table", "\n".join(rows), None
        elif kind == "p":
            style = next((v for s in node.iter() if _local(s.tag) == "pStyle" for v in s.attrib.values()), "")
            numbered = any(_local(s.tag) == "numPr" for s in node.iter())
            title = style.lower().startswith(("title", "heading"))
            yield ("Title" if title else "ListItem" if numbered else "NarrativeText"), _texts(node), None


def parse_pptx(data: bytes) -> Iterator[Element]:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        slides = [n for n in archive.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)]
        for name in sorted(slides, key=lambda n: int(re.findall(r"\d+", n)[-1])):
            page = int(re.findall(r"\d+", name)[-1])
            for shape in _xml(archive, name).iter():
                if _local(shape.tag) == "sp":
                    title = any(_local(s.tag) == "ph" and "itle" in s.attrib.get("type", "") for s in shape.iter())
                    text = "\n".join(_texts(p) for p in shape.iter() if _local(p.tag) == "p")
                    yield ("Title" if title else "NarrativeText"), text, page


def parse_xlsx(data: bytes) -> Iterator[Element]:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = archive.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = [_texts(si) for si in _xml(archive, "xl/sharedStrings.xml")]
        sheets = [n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)]
        for name in sorted(sheets, key=lambda n: int(re.findall(r"\d+", n)[-1])):
            rows = []
            for row in _xml(archive, name).iter():
                if _local(row.tag) != "row":
                    continue
                cells = []
                for cell in row:
                    value = next((v.text or "" for v in cell if _local(v.tag) == "v"), _texts(cell))
                    cells.append(shared[int(value)] if cell.attrib.get("t") == "s" else value)
                rows.append(" | ".join(cells))
            yield "Table", "\n".join(rows), int(re.findall(r"\d+", name)[-1])


def parse_pdf(data: bytes) -> Iterator[Element]:
    from pypdf import PdfReader  # optional

    for number, page in enumerate(PdfReader(io.BytesIO(data)).pages, start=1):
        yield "NarrativeText", page.extract_text() or "", number


PARSERS: dict[str, Callable[[bytes], Iterator[Element]]] = {
    ".txt": parse_text, ".md": parse_markdown, ".docx": parse_docx, ".pptx": parse_pptx,
    ".xlsx": parse_xlsx, ".pdf": parse_pdf,
}


def plain_text(data: bytes) -> Iterator[Element]:
    """Any UTF-8 text without control bytes, whatever its extension; else an error."""
    if b"\0" in data:
        raise ValueError("binary content")
    yield from parse_text(data)


def elements_of(path: str, data: bytes, fallback: bool) -> list[tuple]:
    """Rows of one file, or one row that says why there are none."""
    match = re.search(r"\.[A-Za-z0-9]+$", path)
    parser = PARSERS.get(match.group(0).lower()) if match else None
    reason = "ValueError: unsupported format"
    for attempt in (parser, plain_text if fallback else None):
        if attempt is None:
            continue
        try:
            found = [(kind, text.strip(), page) for kind, text, page in attempt(data)]
            return [(path, i, kind, text, page, None) for i, (kind, text, page) in enumerate(found) if text]
        except Exception as error:  # the file goes to the rejects, with what its own parser said
            reason = f"{type(error).__name__}: {error}" if attempt is parser else reason
    return [(path, None, None, None, None, reason)]


def parse_all(files: DataFrame, fallback: bool = False) -> DataFrame:
    """One row per element, and one with ``error`` per file that could not be read.

    With ``fallback`` a file that its parser refuses, or that has none, is read as plain text
    if it is text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows += elements_of(path, bytes(content), fallback)
            out = pd.DataFrame(rows, columns=["path", "position", "type", "text", "page_number", "error"])
            yield out.astype({"position": "Int64", "page_number": "Int64"})

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def parse_files(files: DataFrame, fallback: bool = False) -> tuple[DataFrame, DataFrame]:
    """(elements, rejects): rejects carry the path and why it could not be read."""
    parsed = parse_all(files, fallback)
    good = parsed.filter("error is null").drop("error")
    return good, parsed.filter("error is not null").select("path", "error")
