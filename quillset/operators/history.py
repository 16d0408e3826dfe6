"""Run history and session retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# History length and session lifetime.
HISTORY_LIMIT, MAX_AGE_MS = 50, 24 * 60 * 60 * 1000


def append_run(run: DataFrame, path: str) -> None:
    """Append one row per run to the history table."""
    run.write.mode("append").parquet(path)


def latest_runs(history: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """Newest runs first (the last inserted wins among equal times)."""
    return history.orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)


def pending_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.filter(F.col("status") != "completed")


def split_expired(sessions: DataFrame, now_ms: Column, max_age_ms: int = MAX_AGE_MS) -> tuple[DataFrame, DataFrame]:
    """(sessions to keep, sessions older than the limit)."""
    expired = now_ms - F.col("updated_at") > max_age_ms
    return sessions.filter(~expired), sessions.filter(expired)


def session_progress(rounds: DataFrame) -> DataFrame:
    """Rounds and items per session from its valid round log."""
    return rounds.groupBy("session_id").agg(
        F.count("*").alias("total_rounds"),
        F.sum("item_count").alias("total_items"),
        F.max_by("finish_reason", "round").alias("last_finish_reason"),
    )
