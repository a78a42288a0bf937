"""Line audit of source texts: hard-coded values, open tasks, undeclared variables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweir.functions.text import strip

# What counts as hard-coded, as an open task, and as a variable.
HARD_CODED = {
    "localhost": r"localhost",
    "local ip": r"127\.0\.0\.1",
    "api key": r"sk-[a-zA-Z0-9]{48}",
    "database url": r"postgresql://[^\"']+",
    "redis url": r"redis://[^\"']+",
    "http url": r"http://[^\"']+",
    "https url": r"https://[^\"']+",
}
OPEN_TASKS = {"todo": "TODO:", "fixme": "FIXME:", "hack": "HACK:", "xxx": "XXX:"}
ENV_USE = r"os\.getenv\([\"']([^\"']+)[\"']"
ENV_NAME = r"[A-Za-z0-9_]+"


def lines(texts: DataFrame, path: str, text: str) -> DataFrame:
    """(path, line_no, line) of whole texts."""
    rows = texts.select(F.col(path).alias("path"), F.posexplode(F.split(text, "\n")).alias("i", "line"))
    return rows.select("path", (F.col("i") + 1).cast("long").alias("line_no"), "line")


def _findings(rows: DataFrame, patterns: dict[str, str], comment: str = "#") -> DataFrame:
    hits = F.filter(F.array(*[
        F.when(F.col("line").rlike(p), F.lit(n)) for n, p in patterns.items()
    ]), lambda x: x.isNotNull())
    code = rows.filter(~strip(F.col("line")).startswith(comment)) if comment else rows
    return code.select("path", "line_no", F.explode(hits).alias("finding"), strip(F.col("line")).alias("line"))


def hard_coded(rows: DataFrame, patterns: dict[str, str] = HARD_CODED) -> DataFrame:
    return _findings(rows, patterns)


def open_tasks(rows: DataFrame) -> DataFrame:
    return _findings(rows, OPEN_TASKS, comment="")


def undeclared(rows: DataFrame, declarations: DataFrame) -> DataFrame:
    """Variables that are read somewhere but not named in the declarations."""
    used = rows.select("path", "line_no", F.explode(F.regexp_extract_all("line", F.lit(ENV_USE), F.lit(1))).alias("name"))
    known = declarations.select(F.explode(F.regexp_extract_all("line", F.lit(ENV_NAME), F.lit(0))).alias("name")).distinct()
    return used.join(known, "name", "left_anti")


def report(findings: DataFrame, per_kind: int = 10) -> DataFrame:
    """Count and first examples per kind of finding (a report shows a few)."""
    from corpusweir.operators.topk import top_k

    counts = findings.groupBy("finding").agg(F.count("*").alias("n"))
    first = top_k(findings, ["finding"], [F.asc("path"), F.asc("line_no")], per_kind)
    where: Column = F.concat_ws(":", "path", F.col("line_no").cast("string"))
    examples = first.groupBy("finding").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", where.alias("w")))), lambda s: s["w"]), "\n").alias("examples"))
    return counts.join(examples, "finding")
