"""The whole flow: pages to scored, deduplicated records."""

from __future__ import annotations

import hashlib
import json
import re
import uuid

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillset.operators import dedup, generation, resume
from quillset.operators.generation import rule_based_generator
from quillset.plans.relations import pages_text
from quillset.session import checkpointed, shared_folder
from quillset.sources.files import reject_empty, with_document_columns


def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pages_text(spark, sf_dir).select(
        F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("source_name"),
        F.lit("html").alias("file_type"),
        "text",
    )
    return reject_empty(with_document_columns(pages))[0]


def page_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, generation.ChunkedRun]:
    """(records before deduplication, kept records, run) for the pages table with the rule-based generator."""
    records, run = generation.extract_records(
        page_documents(spark, sf_dir), rule_based_generator, created_at=F.lit(0)
    )
    # Scored once for deduplication and totals; a long-running job would write its records table here.
    records = checkpointed(records.withColumn("document", F.col("source.document_id")))
    kept, _ = dedup.deduplicate_records(records, "document", position="place")
    return records, kept, run


def best_page_records(spark: SparkSession, sf_dir: str, limit: int = 20) -> DataFrame:
    """Flagship query: the best records of the pages, one row each with its source span."""
    _, kept, _ = page_records(spark, sf_dir)
    return kept.orderBy(F.desc("quality.overall"), "id", "pos").limit(limit).select(
        "id",
        "instruction",
        "output",
        F.col("source.file_name").alias("file_name"),
        F.col("source.heading").alias("heading"),
        F.col("source.start_offset").alias("start_offset"),
        F.col("source.end_offset").alias("end_offset"),
        F.col("quality.overall").alias("overall"),
        "task_type",
    )


# Every page longer than this is asked about in parts.
DEEP_PARTS_FROM = 600


def moody_generator(batch: pd.DataFrame) -> list[tuple]:
    """A stand-in that ends its sessions in every way there is, by the page's number modulo 5.

    0: finished at once. 1: asks the same again. 2: two new questions in each round. 3: down in the second round. 4: one new question per part.
    """
    rows = []
    for user in batch["user"]:
        source = user.split("<source>\n", 1)[1].rsplit("\n</source>", 1)[0]
        mood = int(re.search(r"Name: page_(\d+)", user).group(1)) % 5
        number = int(user.split(":")[0].split()[1]) if user.startswith("Round ") else 1
        if mood == 3 and number == 2:
            rows.append((None, None, None, None, "unavailable"))
            continue
        seeds = [source] if mood == 1 else [f"{source}|{number}|{i}" for i in range(1, 3 if mood == 2 else 2)]
        asked = [hashlib.md5(seed.encode()).hexdigest() for seed in seeds]
        raw = json.dumps({"items": [{"instruction": q, "input": "", "output": f"answer to {q}"} for q in asked]})
        rows.append((raw, "stop" if mood == 0 else "length", 1, len(asked), None))
    return rows


def moody_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of a deep run over the pages with ``moody_generator``."""
    docs = page_documents(spark, sf_dir).withColumn("session_id", F.col("source_name"))
    return generation.deep_rounds(docs, moody_generator, compare_with="self", limit=DEEP_PARTS_FROM)[1]


class Interrupted(Exception):
    """Ends a run after a batch, as a lost driver would."""


def unreliable_generator(batch: pd.DataFrame) -> list[tuple]:
    """The rule-based stand-in, down for every request whose length is a multiple of five."""
    answers = rule_based_generator(batch)
    return [(None, None, None, None, "unavailable") if len(user) % 5 == 0 else answer for user, answer in zip(batch["user"], answers, strict=True)]


def _sessions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    docs = checkpointed(page_documents(spark, sf_dir).withColumn("session_id", F.col("source_name")))
    return docs, f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"


def resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run cut off after its first batch and run again: the kept records, and how often each chunk was called."""
    docs, path = _sessions(spark, sf_dir)

    def cut_off(batch_id: int) -> None:
        raise Interrupted(f"after batch {batch_id}")

    try:
        resume.run_in_batches(docs, rule_based_generator, path, batch_chunks=1000, files_per_batch=2, on_batch=cut_off)
    except StreamingQueryException as stopped:
        if "Interrupted" not in str(stopped):
            raise
    run = resume.run_in_batches(docs, rule_based_generator, path, batch_chunks=1000)
    kept = resume.finish_run(docs, path, run, created_at=F.lit(0))
    # Every answer ever stored, by whatever batch, not only those with a marker.
    calls = resume.stored_calls(docs, path)
    return kept.select("session_id", F.col("source.chunk_id").alias("chunk_id"), "id", "pos", "instruction", "output", F.col("quality.overall").alias("overall"), "fingerprint").join(
        calls, ["session_id", "fingerprint", "chunk_id"]
    ).drop("fingerprint")


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a run whose model fails on some chunks, and of the run that tries those again; runs are numbered in order."""
    docs, path = _sessions(spark, sf_dir)
    resume.run_in_batches(docs, unreliable_generator, path, batch_chunks=1000)
    run = resume.run_in_batches(docs, rule_based_generator, path, batch_chunks=1000)
    resume.finish_run(docs, path, run, created_at=F.lit(0))
    events = resume.read_events(spark, path)
    runs = F.when(F.col("run") == run, 2).otherwise(1)
    return events.select(runs.alias("run_no"), "session_id", "chunk_id", "status", "attempt", "items", "message")
