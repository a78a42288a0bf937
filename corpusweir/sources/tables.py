"""Table definitions, domain checks, migrations and table-level reads and writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Column sets of the relational tables (fixed values: names and types).
SCHEMAS = {
    "documents": """id string, title string, content string, file_path string, file_size bigint,
        file_type string, status string, processed boolean, vectorized boolean, vectorization_status string,
        vectorization_time timestamp, metadata_generation_status string,
        metadata_generation_completed_at timestamp, metadata string, created_at timestamp, updated_at timestamp""",
    "sessions": """id string, user_id string, title string, metadata string, created_at timestamp,
        updated_at timestamp, is_active boolean""",
    "chat_history": """id bigint, session_id string, user_message string, assistant_message string,
        question string, answer string, sources string, metadata string, created_at timestamp""",
    "parent_chunks": """id string, document_id string, content string, summary string, keywords string,
        created_at timestamp""",
    "search_history": """id bigint, session_id string, query string, results string, result_count int,
        created_at timestamp""",
    "child_chunks": """id string, content string, document_id string, parent_chunk_id string, summary string,
        keywords array<string>, chunk_type string, child_index int, start_char int, end_char int, title string,
        embedding array<float>""",
}

VECTORIZATION_STATES = ("pending", "processing", "completed", "failed")

# Rows that break a rule go to a reject table with the rule's name.
RULES: dict[str, dict[str, str]] = {
    "documents": {
        "id missing": "id is null",
        "title missing": "title is null",
        "content missing": "content is null",
        "unknown vectorization_status": "vectorization_status not in ('pending', 'processing', 'completed', 'failed')",
    },
    "queries": {
        "query length outside 1..1000": "length(query) not between 1 and 1000",
        "max_results outside 1..20": "max_results not between 1 and 20",
    },
    "feedback": {"rating outside 1..5": "rating not between 1 and 5"},
    "scores": {"score outside [0, 1]": "score not between 0 and 1"},
    "keywords": {
        "scores do not match keywords": "keyword_scores is not null and size(keyword_scores) <> size(keywords)",
        "keyword longer than 50": "exists(keywords, k -> length(k) > 50)",
        "more than 20 keywords": "size(keywords) > 20",
    },
}


def checked(df: DataFrame, rules: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Split rows into valid ones and rejects carrying the broken rules."""
    broken = F.filter(
        F.array(*[F.when(F.expr(f"coalesce({cond}, false)"), F.lit(name)) for name, cond in rules.items()]),
        lambda r: r.isNotNull(),
    )
    marked = df.withColumn("reject_reasons", broken)
    return (
        marked.filter(F.size("reject_reasons") == 0).drop("reject_reasons"),
        marked.filter(F.size("reject_reasons") > 0),
    )


def create_tables(spark: SparkSession, path: str, database: str | None = None) -> None:
    """Create the tables that do not exist, as Parquet under ``path``."""
    prefix = f"{database}." if database else ""
    for name, columns in SCHEMAS.items():
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {prefix}{name} ({columns}) USING parquet LOCATION '{path}/{name}'"
        )


def add_missing_columns(df: DataFrame, table: str) -> DataFrame:
    """Additive migration: columns of the definition that ``df`` lacks become null."""
    for part in SCHEMAS[table].replace("\n", " ").split(", "):
        name, kind = part.split()
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def table_overview(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Catalog introspection: one row per column of every table."""
    rows = [
        (t.name, c.name, c.dataType, c.nullable)
        for t in spark.catalog.listTables(database)
        for c in spark.catalog.listColumns(t.name if not database else f"{database}.{t.name}")
    ]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, nullable boolean")


def backfill_vectorization_time(docs: DataFrame, status: str = "vectorization_status") -> DataFrame:
    missing = (F.col(status) == "completed") & F.col("vectorization_time").isNull()
    return docs.withColumn(
        "vectorization_time", F.when(missing, F.col("updated_at")).otherwise(F.col("vectorization_time"))
    )


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None,
              bounds: tuple[int, int] | None = None, partitions: int = 8) -> DataFrame:
    """A database table; with a numeric key it is read by range in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if key and bounds:
        reader = (
            reader.option("partitionColumn", key).option("lowerBound", bounds[0])
            .option("upperBound", bounds[1]).option("numPartitions", partitions)
        )
    return reader.load()


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def migrate(source: dict[str, DataFrame], target: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Copy between stores: documents and sessions by key, histories appended."""
    from corpusweir.operators.relational import upsert

    out = {}
    for name, rows in source.items():
        have = target.get(name)
        if have is None:
            out[name] = rows
        elif name in ("documents", "sessions", "parent_chunks"):
            out[name] = upsert(have, rows.select(*have.columns), "id")
        else:
            out[name] = have.unionByName(rows.select(*have.columns))
    return out


def json_results(df: DataFrame, path: str) -> None:
    """One JSON object per document, sharded by Spark."""
    df.write.mode("overwrite").json(path)


def can_retry(status: Column, retries: Column, max_retries: Column) -> Column:
    return (status == "failed") & (retries < max_retries)


def task_seconds(started: Column, completed: Column) -> Column:
    return F.when(started.isNotNull() & completed.isNotNull(),
                  completed.cast("double") - started.cast("double"))
