"""Session defaults and the two places where an operator may cut lineage."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


# Rows of whole texts sent to a Python worker at once.
BATCH_ROWS = 512


def build_session(master: str | None = None, app: str = "quillset", **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; a cluster's own settings win when already set."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Executors may be lost at any time, so blocks held only by executors are never enough. A folder of our own is used only when none is configured
    (tests, local runs); on any other master that is an error, since executors would not see a machine-local folder.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", own)
    return own


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def set_small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """From now on the session sends Python workers at most ``rows`` rows at once, so their memory does not grow with the rows of a task.

    Spark's own bound of 10,000 is meant for numbers: as prompts or texts that is tens of MB, held several times over in each worker.
    """
    if not 0 < int(spark.conf.get(ARROW_ROWS)) <= rows:
        spark.conf.set(ARROW_ROWS, str(rows))


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """``set_small_batches`` for what is run inside."""
    before = spark.conf.get(ARROW_ROWS)
    set_small_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in reliable storage and drop its lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    with small_batches(df.sparkSession):
        return df.checkpoint(eager=True)


def persisted(df: DataFrame) -> DataFrame:
    """Cache a relation read several times by one operator (recomputable, spills to disk)."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
