"""Session helpers: checkpoint folder, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting one only for a local session.

    A cluster names a shared folder in ``spark.checkpoint.dir``; a machine-local
    folder would not survive the loss of an executor, so it is refused there.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="marketspark-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def stage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder so that later steps read it once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast only after counting that it has at most ``max_rows`` rows."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def local_session(cores: str = "8", partitions: str = "8") -> SparkSession:
    """Session for tests and local checks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("marketspark")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.autoBroadcastJoinThreshold", "10MB")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
