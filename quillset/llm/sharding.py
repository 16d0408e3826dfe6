"""Shards through fixed virtual slots: records hash into thousands of slots, bytes are summed per slot, and a small versioned
table maps slots to shards. Rebalancing edits that table; records are never hashed anew.

Law ``bytes``: shard sizes are near equal (slots are placed largest first on the lightest shard, so no two shards differ by more than the
last slot placed). Defined results: a null text has no bytes and checksum 0; a null ``doc_id`` hashes as null like any other value;
rows that repeat stay together in one slot and are numbered one after the other; no rows give an empty result and a map of empty
slots; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillset.llm.shared import Scratch, gapless, own_columns

ROW_BYTES = 8


def slotted(docs: DataFrame, slots: int) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot for every row."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return own_columns(docs, doc_id="doc_id", text="text").select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(raw) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(raw).cast("bigint").alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_bytes(rows: DataFrame, slots: int) -> DataFrame:
    """virtual_slot, bytes for all ``slots``, empty ones included."""
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    summed = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"))
    return every.join(summed, "virtual_slot", "left").select("virtual_slot", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def _placed(ordered: DataFrame, start: Column) -> DataFrame:
    """Put each slot of one array (largest first) on the shard that is lightest so far; the array has one entry per slot."""
    step = F.aggregate(
        "slots",
        F.struct(start.alias("loads"), F.expr("cast(array() as array<struct<virtual_slot:int,shard:int>>)").alias("out")),
        lambda acc, s: F.struct(
            F.transform(
                acc["loads"],
                lambda load, i: F.when(i == F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1, load + s["bytes"]).otherwise(load),
            ).alias("loads"),
            F.concat(
                acc["out"],
                F.array(F.struct(s["virtual_slot"].alias("virtual_slot"), (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int").alias("shard"))),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return ordered.select(F.explode(step).alias("s")).select("s.virtual_slot", "s.shard")


def _largest_first() -> Column:
    """Slots as one array; their number is the fixed parameter ``slots``, whatever the number of records."""
    return F.sort_array(F.collect_list(F.struct("bytes", F.col("virtual_slot"))), asc=False)


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """virtual_slot, shard, version 1 from slot sizes."""
    return _placed(sizes.agg(_largest_first().alias("slots")), F.array_repeat(F.lit(0).cast("bigint"), shards)).withColumn("version", F.lit(1))


def rebalanced(now: DataFrame, sizes: DataFrame, shards: int, tolerance: float = 0.02) -> DataFrame:
    """The next version of a map: only slots that must move get another shard.

    Each shard keeps its largest slots up to its fair share (shards beyond the new number keep none); the slots left over are
    placed, largest first, on the lightest shards. ``tolerance`` is how far above its fair share a shard may stay unmoved.
    """
    total, version = sizes.agg(F.sum("bytes")).first()[0] or 0, now.agg(F.max("version")).first()[0] or 0
    grown = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    fits = (F.sum("bytes").over(grown) <= total / shards * (1 + tolerance)) & (F.col("shard") < shards)
    judged = now.join(sizes, "virtual_slot").select("virtual_slot", "shard", "bytes", fits.alias("stays"))
    kept = judged.filter("stays")
    loads = {r["shard"]: r["load"] for r in kept.groupBy("shard").agg(F.sum("bytes").alias("load")).collect()}  # one row per shard
    start = F.array(*[F.lit(loads.get(i, 0)).cast("bigint") for i in range(shards)])
    moved = _placed(judged.filter("NOT stays").agg(_largest_first().alias("slots")), start)
    return kept.select("virtual_slot", "shard").unionAll(moved).withColumn("version", F.lit(version + 1))


def save_map(table: DataFrame, path: str) -> None:
    """Add one version; earlier ones stay readable, each in a folder of its own."""
    table.repartition(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of a stored map, the latest unless given."""
    stored = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.filter(F.col("version") == version)


def shard_documents(docs: DataFrame, shards: int = 24, slots: int = 4096, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (the row's number in its shard), grown_shard, virtual_slot, map_version.

    The map is read from ``map_path``, and with it the number of slots; without one it is derived from the bytes of these rows and stored as version 1.
    """
    spark = docs.sparkSession
    if map_path is not None:
        slots = load_map(spark, map_path).count()
    rows = slotted(docs, slots)
    if map_path is None:
        map_path = Scratch(spark, "shards").path("slot-map")
        save_map(first_map(slot_bytes(rows, slots), shards), map_path)
    where = load_map(spark, map_path).select("virtual_slot", "shard", F.col("version").alias("map_version"))
    # The map has one row per slot, so its size is fixed by a parameter.
    placed = rows.join(F.broadcast(where), "virtual_slot")
    return gapless(placed, "shard", "virtual_slot", ["doc_id", "text_crc32", "size"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version"
    )
