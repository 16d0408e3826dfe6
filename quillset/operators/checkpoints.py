"""Resumable runs: fingerprints, completed chunks and their stored records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What the fingerprint covers besides the text.
SCHEMA_VERSION, CHUNK_OVERLAP = 1, 240

CHUNK_KEY = ["session_id", "fingerprint", "chunk_id"]


def run_fingerprint(max_chars: int = 6000) -> Column:
    """SHA-256 over the text followed by the JSON of the run's settings."""
    settings = F.to_json(
        F.struct(
            F.col("file_type").alias("fileType"),
            F.lit(max_chars).alias("maxCharsPerChunk"),
            F.lit(CHUNK_OVERLAP).alias("chunkOverlap"),
            F.lit(SCHEMA_VERSION).alias("schemaVersion"),
        )
    )
    return F.sha2(F.concat("text", settings), 256)


def compatible(checkpoints: DataFrame, runs: DataFrame) -> DataFrame:
    """Stored entries usable for a run: same session, same fingerprint, known schema version."""
    current = runs.select("session_id", "fingerprint")
    return checkpoints.filter(F.col("schema_version") == SCHEMA_VERSION).join(current, ["session_id", "fingerprint"], "left_semi")


def pending_chunks(chunks: DataFrame, completed: DataFrame) -> DataFrame:
    """Chunks not completed by their own session under the same fingerprint; another session's progress on an equal text does not count."""
    return chunks.join(completed.select(*CHUNK_KEY), CHUNK_KEY, "left_anti")


def save_completed(spark: SparkSession, path: str, finished: DataFrame, records: DataFrame) -> None:
    """Append newly completed chunks and their raw records, both keyed by session, fingerprint and chunk.

    Records are written first: a chunk counts as completed only once its marker exists, so an interrupted save is repeated
    and :func:`load_completed` reads each chunk's records by the batch its marker names.
    """
    batch = F.expr("uuid()")
    new = finished
    known = _read(spark, f"{path}/completed")
    if known is not None:
        new = finished.join(known.select(*CHUNK_KEY), CHUNK_KEY, "left_anti")
    token = spark.range(1).select(batch.alias("b")).first()["b"]
    new = new.withColumns({"batch": F.lit(token), "schema_version": F.lit(SCHEMA_VERSION), "updated_at": F.unix_millis(F.current_timestamp())})
    from quillset.session import checkpointed

    new = checkpointed(new)
    rows = records.join(new.select(*CHUNK_KEY), CHUNK_KEY, "left_semi")
    rows.withColumn("batch", F.lit(token)).write.mode("append").parquet(f"{path}/records")
    new.write.mode("append").parquet(f"{path}/completed")


def load_completed(spark: SparkSession, path: str, runs: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """(completed markers, their records) usable for ``runs``; (None, None) before anything was saved."""
    markers, records = _read(spark, f"{path}/completed"), _read(spark, f"{path}/records")
    if markers is None:
        return None, None
    usable = compatible(markers, runs)
    if records is None:
        return usable, None
    return usable, records.join(usable.select(*CHUNK_KEY, "batch"), [*CHUNK_KEY, "batch"], "left_semi")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None
