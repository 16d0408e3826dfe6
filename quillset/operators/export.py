"""Alpaca and ShareGPT exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exportable(records: DataFrame, *scope: str) -> DataFrame:
    """Accepted rows where the set is under review (some row has a status), all rows otherwise.

    The decision is per ``scope`` (e.g. per file) or one scalar for the whole set.
    """
    if "review_status" not in records.columns:
        return records
    under_review = F.bool_or(F.col("review_status").isNotNull())
    accepted = F.col("review_status") == "accepted"
    if not scope:
        return records.filter(accepted | ~F.coalesce(records.agg(under_review).scalar(), F.lit(False)))
    managed = records.groupBy(*scope).agg(under_review.alias("__managed"))
    return records.join(managed, list(scope)).filter(~F.col("__managed") | accepted).drop("__managed")


def to_alpaca(records: DataFrame, *keep: str) -> DataFrame:
    return records.select(*keep, "instruction", "input", "output")


def to_sharegpt(records: DataFrame, *keep: str) -> DataFrame:
    human = F.when(F.col("input") != "", F.concat("instruction", F.lit("\n\n"), "input")).otherwise(F.col("instruction"))
    turn = lambda who, value: F.struct(F.lit(who).alias("from"), value.alias("value"))
    return records.select(*keep, F.array(turn("human", human), turn("gpt", F.col("output"))).alias("conversations"))


FORMATS = {"alpaca": to_alpaca, "sharegpt": to_sharegpt}


def export_name(file_name: Column, fmt: str) -> Column:
    return F.concat(F.regexp_replace(file_name, "\\.[^.]+$", ""), F.lit(f"_{fmt}.json"))


def write_export(records: DataFrame, path: str, fmt: str = "alpaca") -> None:
    """JSON lines of the exportable rows; internal columns never leave."""
    FORMATS[fmt](exportable(records)).write.mode("overwrite").json(path)


def write_combined(records: DataFrame, files: DataFrame, path: str, fmt: str = "alpaca") -> None:
    """One export of all files whose run succeeded."""
    write_export(_of_successful(records, files), path, fmt)


def write_per_file(records: DataFrame, files: DataFrame, path: str, fmt: str = "alpaca") -> None:
    """One folder per source file that has something to export."""
    named = _of_successful(records, files).withColumn("export_name", export_name(F.col("source.file_name"), fmt))
    chosen = exportable(named, "export_name")
    FORMATS[fmt](chosen, "export_name").write.mode("overwrite").partitionBy("export_name").json(path)


def _of_successful(records: DataFrame, files: DataFrame) -> DataFrame:
    done = files.filter(F.col("status") == "done").select(F.col("file_name").alias("__file"))
    return records.join(done, F.col("source.file_name") == F.col("__file"), "left_semi")
