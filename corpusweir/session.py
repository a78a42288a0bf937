"""Session set-up and the few cluster-level helpers every operator shares."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side may be hinted for broadcast only when its row count was measured to
# stay below this bound; beyond it the join shuffles and AQE handles skew.
BROADCAST_ROWS = 200_000


def build_session(app: str = "corpusweir", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, skew join)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application.

    Functions that run in tasks import it there, wherever the workers start.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="corpusweir-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in root.rglob("*.py"):
            z.write(source, source.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    It is the cluster's ``spark.checkpoint.dir``; a temporary one is created
    only for a local master where none is configured.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", "") or ""
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="corpusweir-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably: executors may be lost at any time."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written_table(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as Parquet in the shared folder: columns stay prunable."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint ``df`` for broadcast only after measuring that it is small.

    The probe stops at ``max_rows + 1`` rows.  A larger side is returned
    without a hint, so the join shuffles instead.
    """
    return F.broadcast(df) if is_few(df, max_rows) else df


def lookup_join(rows: DataFrame, big: DataFrame, key: str, how: str = "inner", few: bool | None = None) -> DataFrame:
    """Join a few ``rows`` with a large table.

    The keys are broadcast when they are known (``few``) or measured to be few,
    so the large table is filtered where it is scanned and only its matching rows
    are shuffled.  With more keys it is a plain join.
    """
    if few is False:
        return rows.join(big, key, how)
    keys = rows.select(key).filter(F.col(key).isNotNull()).distinct()
    return rows.join(big.join(F.broadcast(keys) if few else bounded_broadcast(keys), key, "left_semi"), key, how)


def is_few(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    return df.limit(limit + 1).count() <= limit
