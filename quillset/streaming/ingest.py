"""Incremental processing of arriving documents and items, resumable after a failure.

Each micro-batch writes its output under its batch id, replacing whatever an interrupted attempt at the same batch left
there, so replays never duplicate rows. Progress lives in the stream's checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillset.operators.dedup import ROUND_THRESHOLD, drop_known


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """Rows of all finished batches (of those before ``before``), or None when there are none yet."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.option("basePath", path).parquet(path)
    except AnalysisException:
        return None
    return (rows if before is None else rows.filter(F.col("batch_id") < before)).drop("batch_id")


def process_documents(docs: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Run ``transform`` (for example chunk and score) over each micro-batch of a document stream."""
    return (
        docs.writeStream.foreachBatch(lambda batch, batch_id: write_batch(transform(batch), path, batch_id))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def keep_new_items(items: DataFrame, path: str, checkpoint: str, *scope: str, threshold: float = ROUND_THRESHOLD) -> StreamingQuery:
    """Append the items of each micro-batch that are unlike everything kept by earlier batches.

    The kept set is a table, not operator state; items of one batch are not compared with each other.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        kept = read_batches(batch.sparkSession, path, before=batch_id)
        new = batch if kept is None else drop_known(batch, kept, *scope, threshold=threshold)
        write_batch(new, path, batch_id)

    return items.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
