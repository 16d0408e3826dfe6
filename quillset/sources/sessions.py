"""Session metadata, round logs and stored question lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from quillset.functions.text import explode_positions, is_blank
from quillset.operators.evidence import with_no_evidence
from quillset.operators.quality import build_records
from quillset.operators.responses import strict_json

SESSION_SCHEMA = StructType(
    [
        StructField("sessionId", StringType()),
        StructField("status", StringType()),
        StructField("createdAt", LongType()),
        StructField("updatedAt", LongType()),
        StructField(
            "sourceFile",
            StructType([StructField("filePath", StringType()), StructField("fileName", StringType()), StructField("fileType", StringType())]),
        ),
    ]
)
ITEM_SCHEMA = ArrayType(
    StructType([StructField("instruction", StringType()), StructField("input", StringType()), StructField("output", StringType())])
)
# Provenance of rows stored without any.
STORED_DOCUMENT, STORED_FILE, STORED_TYPE = "legacy_dataset", "历史数据", "txt"


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Session metas below ``path`` (``<session>/meta.json``); unreadable files are left out."""
    raw = (
        spark.read.schema(SESSION_SCHEMA)
        .option("multiLine", "true")
        .option("mode", "DROPMALFORMED")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "meta.json")
        .json(path)
    )
    return raw.filter(F.col("sessionId").isNotNull()).select(
        F.col("sessionId").alias("session_id"),
        "status",
        F.col("createdAt").alias("created_at"),
        F.col("updatedAt").alias("updated_at"),
        F.col("sourceFile.fileName").alias("file_name"),
        F.col("sourceFile.fileType").alias("file_type"),
    )


def read_round_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log lines as (session_id, line_no, line) from ``<session>/*.jsonl``; a log belongs to one session."""
    logs = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path, wholetext=True)
        .withColumn("session_id", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
        .withColumn("__lines", F.split("value", "\n", -1))
    )
    lines = explode_positions(logs, "__lines", "session_id")
    return lines.select("session_id", F.col("pos").cast("bigint").alias("line_no"), F.col("item").alias("line"))


def valid_rounds(lines: DataFrame) -> DataFrame:
    """Rounds before the first bad line of each session, with ``truncated`` telling whether there was one.

    A line is good when it is JSON with a numeric round and an array of items; blank lines are skipped. Only the smallest bad
    position per session is aggregated; the lines themselves are never grouped.
    """
    checked = lines.filter(~is_blank(F.col("line"))).withColumn("__json", strict_json(F.col("line")))
    checked = checked.withColumn("__v", F.try_parse_json("__json"))
    round_no = F.try_variant_get("__v", "$.round", "variant")
    kinds = F.schema_of_variant(round_no)
    good = (
        F.coalesce(kinds.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))
        & F.try_variant_get("__v", "$.items", "array<variant>").isNotNull()
    )
    checked = checked.withColumn("__good", good)
    bad = checked.filter(~F.col("__good")).groupBy("session_id").agg(F.min("line_no").alias("__bad"))
    kept = checked.join(bad, "session_id", "left").filter(F.col("__bad").isNull() | (F.col("line_no") < F.col("__bad")))
    return kept.select(
        "session_id",
        "line_no",
        F.try_variant_get("__v", "$.round", "bigint").alias("round"),
        F.try_variant_get("__v", "$.finishReason", "string").alias("finish_reason"),
        F.size(F.try_variant_get("__v", "$.items", "array<variant>")).cast("bigint").alias("item_count"),
        F.get_json_object("__json", "$.items").alias("items_json"),
        F.col("__bad").isNotNull().alias("truncated"),
    )


def round_items(rounds: DataFrame) -> DataFrame:
    """The items of valid rounds, one row each."""
    parsed = rounds.withColumn("__items", F.from_json("items_json", ITEM_SCHEMA))
    items = explode_positions(parsed, "__items", "session_id", "round")
    return items.select("session_id", "round", (F.col("pos") + 1).cast("bigint").alias("item_no"), "item.*")


# Names that the columns of a round have in its line.
LINE_NAMES = {"valid_count": "validCount", "finish_reason": "finishReason", "token_usage": "tokenUsage"}


def append_rounds(rounds: DataFrame, path: str) -> None:
    """Append rounds (session_id, round, items, valid_count, finish_reason, ...) to the log under ``path``, a JSON line each.

    Every call is one folder ``at=<number of the call>``, so an append touches no earlier file, and a session's lines stay in order without a
    folder per session. Read back with ``read_appended``. A log has one writer at a time.
    """
    hadoop = rounds.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(rounds.sparkSession._jsc.hadoopConfiguration())
    done = [f.getPath().getName() for f in fs.listStatus(hadoop)] if fs.exists(hadoop) else []
    number = max([int(name.removeprefix("at=")) for name in done if name.startswith("at=")], default=0) + 1
    named = rounds.withColumnsRenamed({k: v for k, v in LINE_NAMES.items() if k in rounds.columns})
    line = F.to_json(F.struct(*[F.col(c) for c in named.columns if c != "session_id"]))
    named.select(F.col("session_id").cast("string"), F.col("round").cast("bigint"), line.alias("line")).write.parquet(f"{path}/at={number:08d}")


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a log of ``append_rounds`` as (session_id, line_no, line), in the order of the calls, then of the rounds.

    A session's log is a handful of rounds, so numbering it is one small window per session; folders of calls that did not end are left out.
    """
    schema = "session_id string, round bigint, line string, at bigint"
    files = spark.read.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path)
    order = Window.partitionBy("session_id").orderBy("at", "round", "line")
    return files.select("session_id", (F.row_number().over(order) - 1).cast("bigint").alias("line_no"), "line")


def promote_stored(items: DataFrame, position: Column) -> DataFrame:
    """Stored rows without provenance become records with no evidence, numbered by their 0-based position."""
    chunk = F.format_string("legacy_%03d", position + 1)
    sourced = with_no_evidence(items, F.lit(STORED_DOCUMENT), F.lit(STORED_FILE), F.lit(STORED_TYPE), chunk)
    return build_records(sourced, created_at=F.lit(0))


def read_stored(spark: SparkSession, path: str, record_schema: StructType) -> DataFrame:
    """A stored list (one JSON array per file) as records: complete ones as they are, the others promoted.

    A row is complete when it has id, source, quality and review status.
    """
    lists = spark.read.text(path, wholetext=True).withColumn("__rows", F.from_json("value", ArrayType(record_schema)))
    rows = explode_positions(lists, "__rows").select("pos", "item.*")
    complete = F.col("source").isNotNull() & F.col("quality").isNotNull()
    complete = complete & (F.coalesce("id", F.lit("")) != "") & (F.coalesce("review_status", F.lit("")) != "")
    stored = rows.filter(complete)
    promoted = promote_stored(rows.filter(~F.coalesce(complete, F.lit(False))).select("pos", "instruction", "input", "output"), F.col("pos"))
    return stored.unionByName(promoted, allowMissingColumns=True)
