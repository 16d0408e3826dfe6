"""A corpus from raw documents to training batches: toxic documents go, exact and near copies go, secrets are masked, the rest is packed.

Every stage reads what its predecessor wrote, as Parquet, and takes all of it; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillset.llm import exact_dedup, near_dedup, packing, secrets, toxicity
from quillset.llm.shared import Scratch
from quillset.session import set_small_batches, small_batches

TOXIC_AT, NEAR_PERCENT = 0.7, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below ``TOXIC_AT`` by a lexicon learned from the labels beside the corpus."""
    lexicon = toxicity.learn_lexicon(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), predicted_at=TOXIC_AT)
    set_small_batches(spark)  # not only here: the caller writes what is returned
    # Columns are numbered on the way, so that none of theirs can clash with those of the score.
    numbers = [f"c{i}" for i in range(len(docs.columns))]
    texts = docs.toDF(*numbers).withColumn("text", F.col(numbers[docs.columns.index("text")]))
    clean = toxicity.score_documents(texts, lexicon, tuple(numbers)).filter(F.col("score") < TOXIC_AT)
    return clean.select(*[F.col(n).alias(c) for n, c in zip(numbers, docs.columns, strict=True)])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the smallest doc_id."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (``NEAR_PERCENT`` of their five-word shingles), that with the smallest doc_id."""
    dropped = near_dedup.near_duplicates(docs, NEAR_PERCENT).filter("NOT kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    set_small_batches(spark)  # not only here: the caller writes what is returned
    return secrets.redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with its length bucket, batch and place."""
    return packing.pack_documents(docs, buckets=16, budget=65536)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("secret scan", mask_secrets), ("packing", pack)]

# The lexicon is learned, and near copies are found by branching: neither can be stated in SQL (tests hold them to brute force).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    with small_batches(spark):
        for k, (_, stage) in enumerate(STAGES):
            docs = scratch.store(stage(spark, docs, sf_dir), f"stage-{k}")
            if last is not None:
                scratch.forget(last)
            last = f"stage-{k}"
    return docs
