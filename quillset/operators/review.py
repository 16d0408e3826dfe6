"""Review state: summaries, status updates, edits and restored duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillset.functions.text import js_trim, round_half_up
from quillset.operators.quality import MEDIUM_FROM, STRONG_FROM, rescore

STATUSES = ("pending", "accepted", "rejected", "needs_revision")


def review_summary(records: DataFrame, *by: str) -> DataFrame:
    """Counts per status and quality band, mean quality (0 when empty) and review coverage in percent."""
    overall = F.col("quality.overall")
    counts = [F.count_if(F.col("review_status") == status).alias(status) for status in STATUSES]
    summary = records.groupBy(*by).agg(
        F.count("*").alias("total"),
        *counts,
        F.count_if(overall < MEDIUM_FROM).alias("attention"),
        F.count_if(overall >= STRONG_FROM).alias("strong"),
        # Scores have three decimals: an integer sum is exact and the same in every order.
        F.sum(F.round(overall * 1000).cast("bigint")).alias("__milli"),
    )
    mean = F.coalesce(F.col("__milli") / 1000.0 / F.col("total"), F.lit(0.0))
    reviewed = F.col("accepted") + F.col("rejected") + F.col("needs_revision")
    return summary.withColumns({"average_quality": mean, "coverage": percent(reviewed, F.col("total"))}).drop("__milli")


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, half up; 0 when there is nothing."""
    return F.when(whole == 0, F.lit(0)).otherwise(round_half_up(part * 100 / whole, 0)).cast("bigint")


def files_in_order(records: DataFrame, position: str = "pos") -> DataFrame:
    return records.groupBy(F.col("source.file_name").alias("file_name")).agg(F.min(position).alias("first_pos"))


def batch_breakdown(files: DataFrame, records: DataFrame) -> DataFrame:
    """Per file: status, item count and error. ``files`` has (file_name, status, error)."""
    counts = records.groupBy(F.col("source.file_name").alias("file_name")).agg(
        F.count("*").alias("item_count"), F.count_if(F.col("review_status") == "accepted").alias("accepted")
    )
    joined = files.join(counts, "file_name", "left")
    done = F.col("status") == "done"
    return joined.select(
        "file_name",
        "status",
        F.when(done, F.coalesce("item_count", F.lit(0))).otherwise(0).cast("bigint").alias("item_count"),
        F.when(done, F.coalesce("accepted", F.lit(0))).otherwise(0).cast("bigint").alias("accepted"),
        F.when(~done, F.col("error")).alias("error"),
    )


def batch_summary(breakdown: DataFrame) -> DataFrame:
    """Totals of one batch with its success rate and what can be exported."""
    done = F.col("status") == "done"
    totals = breakdown.agg(
        F.count("*").alias("total_files"),
        F.count_if(done).alias("success_files"),
        F.count_if(~done).alias("failed_files"),
        F.coalesce(F.sum(F.when(done, F.col("item_count"))), F.lit(0)).alias("total_items"),
        F.coalesce(F.sum(F.when(done, F.col("accepted"))), F.lit(0)).alias("accepted_items"),
        F.count_if(done & (F.col("accepted") > 0)).alias("exportable_files"),
    )
    return totals.withColumn("success_rate", percent(F.col("success_files"), F.col("total_files")))


def last_updates(updates: DataFrame, sequence: str = "sequence", keys: Sequence[str] = ("id",)) -> DataFrame:
    """The last row per ``keys``: by ``sequence`` where updates carry that column, in input order otherwise."""
    at = F.col(sequence) if sequence in updates.columns else F.monotonically_increasing_id()
    names = [c for c in updates.columns if c not in (*keys, sequence)]
    return updates.select(*keys, at.alias("__at"), *names).groupBy(*keys).agg(F.max_by(F.struct(*names), "__at").alias("__last")).select(*keys, "__last.*")


def set_status(records: DataFrame, updates: DataFrame, sequence: str = "sequence", keys: Sequence[str] = ("id",)) -> DataFrame:
    """Apply (id, review_status) updates by id, the last one if there are several; records without one keep theirs.

    An id has 32 bits, so among many records two may share one: name further columns of both sides in ``keys`` to tell them apart.
    """
    changed = last_updates(updates, sequence, keys).select(*keys, F.col("review_status").alias("__status"))
    joined = records.join(changed, list(keys), "left")
    return joined.withColumn("review_status", F.coalesce("__status", "review_status")).select(*records.columns)


def apply_edits(records: DataFrame, edits: DataFrame, sequence: str = "sequence", keys: Sequence[str] = ("id",)) -> DataFrame:
    """Replace fields given in (id, instruction, input, output, review_status) and score edited records again.

    Null means unchanged; of several edits of one record the last counts. Only edited rows are rescored; id and task type never change.
    ``keys`` as in :func:`set_status`.
    """
    fields = ("instruction", "input", "output", "review_status")
    edits = last_updates(edits, sequence, keys)
    changes = edits.select(*keys, *[F.col(f).alias(f"__{f}") for f in fields])
    trimmed = lambda f: js_trim(F.col(f"__{f}")) if f != "review_status" else F.col(f"__{f}")
    edited = records.join(changes, list(keys)).withColumns({f: F.coalesce(trimmed(f), F.col(f)) for f in fields})
    untouched = records.join(edits.select(*keys), list(keys), "left_anti")
    return untouched.select(*records.columns).unionByName(rescore(edited.select(*records.columns)))


def restore_duplicates(
    kept: DataFrame, captured_records: DataFrame, captured: DataFrame, restore: DataFrame, keys: Sequence[str] = ("id",)
) -> tuple[DataFrame, DataFrame]:
    """Bring absorbed records back as pending ones.

    ``captured`` is the audit child table and ``restore`` names absorbed records by ``keys``; returns the new record
    set and the child table without them. Copies within one chunk share their id, as any two of many records may: name the position (and the
    scope it belongs to) in ``keys`` to restore one of them.
    """
    back = captured_records.join(restore.select(*keys), list(keys), "left_semi").withColumn("review_status", F.lit("pending"))
    named = restore.withColumnRenamed("id", "duplicate_id").select(*["duplicate_id" if k == "id" else k for k in keys])
    remaining = captured.join(named, named.columns, "left_anti")
    return kept.unionByName(back.select(*kept.columns)), remaining
