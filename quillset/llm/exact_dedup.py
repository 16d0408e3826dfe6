"""Exact duplicates by deterministic block naming: blocks of equal size are sorted into integer names, then adjacent pairs of
names are named again until one name is left for each document.

Equal texts get equal names and different texts of the same number of blocks different ones, since names stand for the sorted
values themselves: hashes only deal rows to sorting buckets, they never decide equality.

Defined results: a null text is an empty text; an empty text is one empty block; of rows with equal texts that with the smallest
``doc_id`` stays, of rows that repeat that id as well one stays; null ids come after all others; no rows give no rows; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillset.llm.shared import Scratch, own_columns

# A run of white space that is not already one single space: replacing only these equals replacing every run.
UNEVEN_SPACE = "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), UNEVEN_SPACE, " ")


def _name(bucket: Column, order: list[str]) -> Column:
    return F.shiftleft(bucket.cast("bigint"), 40) + F.dense_rank().over(Window.partitionBy("bucket").orderBy(*order))


def _blocks(docs: DataFrame, block_chars: int) -> DataFrame:
    texts = own_columns(docs, doc_id="doc_id", text="text").select(
        F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"), normalised(F.col("text")).alias("text")
    )
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    cut = texts.select("rid", "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), pieces.alias("pieces"))
    each = cut.select("rid", "doc_id", "sha", F.greatest(F.size("pieces"), F.lit(1)).alias("n"), F.posexplode_outer("pieces").alias("pos", "block"))
    return each.select("rid", "doc_id", "sha", "n", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("block", F.lit("")).alias("block"))


def name_documents(docs: DataFrame, scratch: Scratch, block_chars: int = 1024, buckets: int = 16384, hot_share: int = 4096) -> DataFrame:
    """One row per input row: rid, doc_id, text_sha256, n_blocks, name; texts are equal exactly when (n_blocks, name) are.

    Blocks are dealt to ``buckets`` by hash and ranked inside their bucket. A block that makes up at least 1/``hot_share`` of all
    blocks would fill one bucket, so those (at most ``hot_share``, of ``block_chars`` characters each: that bounds the
    broadcast) are found by a count first, named apart, and their rows stay spread.
    """
    spark = docs.sparkSession
    seen = Observation()
    hashed = _blocks(docs, block_chars).select(F.xxhash64("block").alias("h"), "doc_id")
    counted = hashed.groupBy("h").agg(F.count("*").alias("rows"), F.min("doc_id").alias("sample")).observe(seen, F.sum("rows").alias("total"))
    repeated = scratch.store(counted.filter("rows > 1 AND sample IS NOT NULL"), "repeated")
    total = seen.get["total"] or 0
    hot = scratch.store(repeated.filter(F.col("rows") * hot_share >= total).select("h", "sample"), "hot")
    # Each hot hash is represented by one block, read from one document that has it; a colliding block takes the common way.
    holders = docs.join(F.broadcast(hot.select(F.col("sample").alias("doc_id")).distinct()), "doc_id", "left_semi")
    held = _blocks(holders, block_chars).withColumn("h", F.xxhash64("block")).join(F.broadcast(hot.select("h")), "h", "left_semi")
    one_each = held.groupBy("h").agg(F.min("block").alias("block"))
    first = F.shiftleft(F.lit(buckets).cast("bigint"), 40)
    hot_names = scratch.store(one_each.select("block", (first + F.row_number().over(Window.orderBy("block"))).alias("hot_name")), "hot-names")

    rows = _blocks(docs, block_chars).join(F.broadcast(hot_names), "block", "left")
    dealt = rows.select(
        "rid", "doc_id", "n", "pos", "hot_name", F.when(F.col("pos") == 0, F.unhex("sha")).alias("sha"),
        F.when(F.col("hot_name").isNull(), F.col("block")).alias("block"),
        F.pmod(F.when(F.col("hot_name").isNull(), F.xxhash64("block")).otherwise(F.xxhash64("rid", "pos")), F.lit(buckets)).alias("bucket"),
    )
    named = dealt.select("rid", "doc_id", "sha", "n", "pos", F.coalesce("hot_name", _name(F.col("bucket"), ["block"])).alias("name"))
    leaves = scratch.store(named, "leaves")
    scratch.forget("repeated", "hot", "hot-names")

    most = leaves.agg(F.max("n")).first()[0] or 1
    heads = leaves.filter("pos = 0").select("rid", "doc_id", F.lower(F.hex("sha")).alias("text_sha256"), "n", F.col("name").alias("leaf"))
    level, width, done = leaves.filter("n > 1").select("rid", "n", "pos", "name"), 1, []
    while width < most:
        width *= 2
        half = F.col("pos") % 2
        pairs = level.groupBy("rid", "n", F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(half == 0, F.col("name"))).alias("l"), F.coalesce(F.max(F.when(half == 1, F.col("name"))), F.lit(-1)).alias("r")
        )
        distinct = pairs.select("l", "r").distinct().withColumn("bucket", F.pmod(F.xxhash64("l", "r"), F.lit(buckets)))
        names = distinct.select("l", "r", _name(F.col("bucket"), ["l", "r"]).alias("name"))
        merged = scratch.store(pairs.join(names, ["l", "r"]).select("rid", "n", "pos", "name"), f"level-{width}")
        done.append(merged.filter(F.col("n") <= width).select("rid", "name"))
        level = merged.filter(F.col("n") > width)
    final = heads.filter("n = 1").select("rid", "doc_id", "text_sha256", F.col("n").alias("n_blocks"), F.col("leaf").alias("name"))
    if done:
        ends = done[0]
        for more in done[1:]:
            ends = ends.unionAll(more)
        long = heads.filter("n > 1").join(ends, "rid")
        final = final.unionAll(long.select("rid", "doc_id", "text_sha256", F.col("n").alias("n_blocks"), "name"))
    return final


def exact_duplicates(docs: DataFrame, **options: int) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row."""
    scratch = Scratch(docs.sparkSession, "exact")
    named = scratch.store(name_documents(docs, scratch, **options), "named")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("best")
    groups = named.groupBy("n_blocks", "name").agg(F.count("*").alias("group_size"), best).filter("group_size > 1")
    # Stored, so that both sides of the join are plain exchanges, which Spark splits where they are skewed.
    rows = named.join(scratch.store(groups, "groups"), ["n_blocks", "name"], "left")
    return rows.select(
        "doc_id",
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (F.col("best").isNull() | (F.col("best.rid") == F.col("rid"))).alias("kept"),
        "text_sha256",
        "rid",
    )


def without_copies(docs: DataFrame, **options: int) -> DataFrame:
    """The rows of ``docs`` that stay, all columns. Rows are told apart by doc_id and text; of rows that repeat both one stays."""
    scratch = Scratch(docs.sparkSession, "copies")
    judged = exact_duplicates(docs, **options).groupBy(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    keys = scratch.store(judged.agg(F.max("kept").alias("_kept"), F.count("*").alias("_rows")).filter("NOT _kept OR _rows > 1"), "keys")
    of_text = "_of_text"
    while of_text in map(str.lower, docs.columns):
        of_text += "_"
    marked = docs.withColumn(of_text, F.sha2(normalised(F.col("text")).cast("binary"), 256))
    same = lambda k: (marked[of_text] == k["_sha"]) & marked["doc_id"].eqNullSafe(k["_id"])
    repeated = keys.filter("_kept")
    once = marked.join(keys, same(keys), "left_anti")
    first = marked.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", of_text])
    return once.unionAll(first).select(*docs.columns)
