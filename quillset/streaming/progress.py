"""Run events as rows and the progress state derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

CHUNK_EVENT = "type string, run_id string, seq bigint, chunk_id string, done bigint, total bigint, new_items bigint, total_items bigint, status string, message string"
ROUND_EVENT = "type string, run_id string, seq bigint, round bigint, new_items bigint, total_items bigint, finish_reason string, status string, message string"


def chunk_events(progress: DataFrame) -> DataFrame:
    """One event row per finished chunk, ordered by ``seq`` within its run."""
    return progress.select(
        F.lit("chunk").alias("type"),
        F.col("document_id").alias("run_id"),
        F.col("chunk_index").alias("seq"),
        "chunk_id",
        F.col("done").cast("bigint").alias("done"),
        F.col("chunk_total").alias("total"),
        "new_items",
        "total_items",
        F.lit("completed").alias("status"),
        F.lit(None).cast("string").alias("message"),
    )


def round_events(rounds: DataFrame) -> DataFrame:
    """Events of the rounds of ``deep_rounds``: one per round, ``completed`` or ``failed`` with its message, and a ``done`` after the last.

    A session whose round failed stays open, so it has no ``done``. ``seq`` orders the events of a session, resumed runs included.
    """
    event = lambda type_, step, status, message: F.struct(
        F.lit(type_).alias("type"), F.lit(step).alias("step"), status.alias("status"), message.alias("message")
    )
    failed = F.col("stop_reason") == "failed"
    none = F.lit(None).cast("string")
    of_round = event("round", 0, F.when(failed, "failed").otherwise("completed"), F.col("error"))
    closing = F.when(F.col("stop_reason").isNotNull() & ~failed, event("done", 1, F.col("stop_reason"), none))
    listed = rounds.withColumn("__e", F.explode(F.array_compact(F.array(of_round, closing))))
    return listed.select(
        F.col("__e.type").alias("type"),
        F.col("session_id").cast("string").alias("run_id"),
        (2 * F.col("round") - 1 + F.col("__e.step")).cast("bigint").alias("seq"),
        F.col("round").cast("bigint").alias("round"),
        F.col("valid_count").alias("new_items"),
        "total_items",
        "finish_reason",
        F.col("__e.status").alias("status"),
        F.col("__e.message").alias("message"),
    )


def latest_progress(events: DataFrame) -> DataFrame:
    """Latest state per run: works on a table and on a stream (update or complete mode) alike.

    ``max_by`` combines map-side, so a run with very many events costs one row per task; the state is one row per run.
    """
    last = F.max_by(F.struct("done", "total", "total_items"), F.col("seq")).alias("last")
    return events.groupBy("run_id").agg(F.count("*").alias("events"), last).select("run_id", "events", "last.*")


def append_events(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Deliver a stream of event rows to a JSON event log, appended per micro-batch."""
    return (
        events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
