"""Boilerplate lines by distinct-site spread: a HyperLogLog sketch of the sites per line hash, merged by aggregation; lines near the
threshold get exact distinct counts; lines on enough sites are removed everywhere.

Defined results: lines are split at LF, compared after trimming white space, and blank lines are never boilerplate; a null text is empty
(0 lines); a null site is one site of its own; repeated rows and lines add no site; a document whose lines all go keeps an empty text; no
rows give no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillset.llm.shared import Scratch, own_columns

SPACE = " \t\n\x0b\x0c\r"


def key128(text: Column) -> Column:
    """128 bits as two integers; equal keys count as equal. A later argument is hashed with the hash so far as its seed: the constant comes first."""
    return F.struct(F.xxhash64(text).alias("hi"), F.xxhash64(F.lit("second"), text).alias("lo"))


def _documents(docs: DataFrame, site: str) -> DataFrame:
    return own_columns(docs, doc_id="doc_id", site=site, text="text").select("doc_id", F.coalesce("site", F.lit("\0")).alias("site"), F.coalesce("text", F.lit("")).alias("text"))


def line_keys(docs: DataFrame, site: str) -> DataFrame:
    """One row per line that is not blank: key of its text (thi, tlo), position, key of the line (hi, lo), site key."""
    lines = _documents(docs, site).select(key128(F.col("text")).alias("t"), F.xxhash64("site").alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.select("t", "site", "pos", F.btrim("line", F.lit(SPACE)).alias("line")).filter("line != ''")
    return lines.select("t.*", "site", "pos", key128(F.col("line")).alias("k")).select(F.col("hi").alias("thi"), F.col("lo").alias("tlo"), "site", "pos", "k.hi", "k.lo")


def widespread(keys: DataFrame, scratch: Scratch, sites: int, lg_k: int = 12, margin: float = 0.1) -> DataFrame:
    """hi, lo of all lines on at least ``sites`` distinct sites.

    Tasks build a sketch per line they see, sketches merge after the shuffle, so a line in every document costs one row per task. Sketches of
    2^``lg_k`` registers err by about 1.6 %; lines whose estimate lies within ``margin`` (six times that) of the threshold are
    counted exactly.
    """
    sketched = keys.groupBy("hi", "lo").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
    judged = scratch.store(
        sketched.select("hi", "lo", F.hll_sketch_estimate("sketch").alias("estimate")).filter(F.col("estimate") >= sites * (1 - margin)), "estimates"
    )
    sure = judged.filter(F.col("estimate") >= sites * (1 + margin)).select("hi", "lo")
    near = judged.filter(F.col("estimate") < sites * (1 + margin)).select("hi", "lo")
    exact = keys.select("hi", "lo", "site").join(near, ["hi", "lo"], "left_semi").distinct().groupBy("hi", "lo").count()
    return scratch.store(sure.unionAll(exact.filter(F.col("count") >= sites).select("hi", "lo")), "widespread")


def without_boilerplate(docs: DataFrame, site: str = "source", sites: int = 10, **options: float) -> DataFrame:
    """doc_id, text (cleaned), n_lines, n_removed: one row per input row.

    What is removed is looked up by the key of the whole text, so copies share one row of positions and no line travels back to its
    document: only documents are joined, once.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    keys = scratch.store(line_keys(docs, site), "keys")
    gone = keys.select("thi", "tlo", "pos", "hi", "lo").join(widespread(keys, scratch, sites, **options), ["hi", "lo"], "left_semi")
    positions = scratch.store(gone.select("thi", "tlo", "pos").distinct().groupBy("thi", "tlo").agg(F.collect_list("pos").alias("gone")), "positions")
    scratch.forget("keys", "estimates")
    texts = _documents(docs, site).select("doc_id", "text", key128(F.col("text")).alias("t")).select("doc_id", "text", F.col("t.hi").alias("thi"), F.col("t.lo").alias("tlo"))
    joined = texts.join(positions, ["thi", "tlo"], "left").select("doc_id", "text", "gone", F.split("text", "\n").alias("lines"))
    left = F.filter("lines", lambda line, i: ~F.array_contains(F.col("gone"), i))
    return joined.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"),
        F.when(F.col("text") == "", 0).otherwise(F.size("lines")).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
    )
