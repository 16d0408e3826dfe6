"""Generation runs that survive an interruption: chunks are called in micro-batches, and what a batch finished is never asked again.

A run writes its pending chunks as a request table and streams it through ``foreachBatch``. A batch stores items, responses, failures and
messages under its own name and then a marker per finished chunk: (session, fingerprint, chunk), the text's SHA-256 being part of the
fingerprint. Only what a marker names counts, so a batch cut off half-way leaves nothing behind but unread files, and repeating it replaces them. The next
run, in whatever process, asks for the chunks without a marker; chunks that failed have none and are tried again.

Items of all runs are read together, by their markers, before records are built and deduplicated: a resumed run ends with the records of an
uninterrupted one. Events are stored per batch too, under their run and sequence, and can be read as a stream while the run goes on.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillset.operators import dedup
from quillset.operators.checkpoints import CHUNK_KEY, SCHEMA_VERSION, compatible, pending_chunks, run_fingerprint
from quillset.operators.chunking import chunk_documents
from quillset.operators.evidence import bind_to_chunks
from quillset.operators.generation import MAX_ATTEMPTS, ChunkedRun, Generator, generate_for_chunks, order_items
from quillset.operators.quality import build_records
from quillset.session import checkpointed, small_batches

DOCUMENT = ("session_id", "fingerprint", "document_id", "source_name", "file_type")
# A micro-batch has a cost of its own, whatever it holds: a run has at most so many, taking more files each once it needs to.
MOST_BATCHES = 12
EVENT = "run string, seq bigint, session_id string, chunk_id string, status string, attempt int, items bigint, message string"


def _stored(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """All batches of one of the run's tables, with the batch in ``batch``; None before anything was stored."""
    try:
        return spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}/batch=*").withColumn("batch", F.col("batch").cast("string"))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def run_chunks(docs: DataFrame, max_chars: int = 6000, overlap_chars: int = 240) -> DataFrame:
    """Chunks of ``docs`` (session_id and the document columns) with their fingerprint; a text counts once per session."""
    keyed = docs.withColumn("session_id", F.col("session_id").cast("string")).withColumn("fingerprint", run_fingerprint(max_chars))
    first = F.row_number().over(Window.partitionBy("session_id", "fingerprint").orderBy("source_name", "document_id"))
    once = keyed.withColumn("__nth", first).filter("__nth = 1").drop("__nth")
    return chunk_documents(once, *DOCUMENT, max_chars=max_chars, overlap_chars=overlap_chars)


def completed_chunks(chunks: DataFrame, path: str) -> DataFrame | None:
    """Markers usable for ``chunks``, one per chunk: key and the batch that finished it."""
    markers = _stored(chunks.sparkSession, path, "completed")
    if markers is None:
        return None
    usable = compatible(markers, chunks.select("session_id", "fingerprint").distinct())
    # Two runs at a time may finish the same chunk; the earlier batch counts.
    return usable.groupBy(*CHUNK_KEY).agg(F.min("batch").alias("batch"))


def _events(rows: DataFrame, run: str, status: str, attempt: Column | None = None, items: Column | None = None, message: Column | None = None, chunk: Column | None = None) -> DataFrame:
    none = F.lit(None)
    return rows.select(
        F.lit(run).alias("run"), "session_id", (F.col("chunk_id") if chunk is None else chunk).cast("string").alias("chunk_id"), F.lit(status).alias("status"),
        (none if attempt is None else attempt).cast("int").alias("attempt"), (none if items is None else items).cast("bigint").alias("items"),
        (none if message is None else message).cast("string").alias("message"),
    )


def _store_events(events: DataFrame, path: str, run: str, order: int) -> None:
    """One file set per batch; ``seq`` orders a session's events: batch, attempt (a retry before its outcome), chunk."""
    within = F.row_number().over(Window.partitionBy("session_id").orderBy(F.coalesce("attempt", F.lit(0)), F.col("status") != "retrying", "chunk_id", "status"))
    events.withColumn("seq", F.lit(order).cast("bigint") * 10**9 + within).select("run", "seq", "session_id", "chunk_id", "status", "attempt", "items", "message").write.mode("overwrite").parquet(f"{path}/events/batch={run}-{order:06d}")


def _batch_events(run: str, batch: DataFrame, done: ChunkedRun, finished: DataFrame) -> DataFrame:
    # A chunk called k times was retried k - 1 times; messages of the last attempt of a failed chunk stand in its ``failed`` event.
    calls = done.responses.filter("stage = 1").groupBy(*CHUNK_KEY).agg(F.max("attempt").alias("calls"))
    retried = calls.filter("calls > 1").select(*CHUNK_KEY, F.explode(F.sequence(F.lit(2), F.col("calls"))).alias("attempt"))
    counts = done.items.groupBy(*CHUNK_KEY).agg(F.count("*").alias("items"))
    complete = finished.join(counts, CHUNK_KEY, "left").join(calls, CHUNK_KEY)
    failed = done.failures.groupBy(*CHUNK_KEY).agg(F.min("message").alias("message"), F.max("attempts").alias("attempts"))
    return (
        _events(retried, run, "retrying", F.col("attempt"))
        .unionByName(_events(complete, run, "completed", F.col("calls"), F.coalesce("items", F.lit(0))))
        .unionByName(_events(failed, run, "failed", F.col("attempts"), F.lit(0), F.col("message")))
    )


def run_in_batches(
    docs: DataFrame, generator: Generator, path: str, max_chars: int = 6000, overlap_chars: int = 240, max_attempts: int = MAX_ATTEMPTS,
    batch_chunks: int = 2000, files_per_batch: int = 8, on_batch: Callable[[int], None] | None = None,
) -> str:
    """Call the generator for every chunk of ``docs`` that has no marker under ``path`` yet; returns the run's name.

    A micro-batch takes ``files_per_batch`` request files of at most ``batch_chunks`` chunks, or as many as end the run in ``MOST_BATCHES`` batches
    if that is more. ``on_batch`` hears of every stored batch; an exception
    there, or a lost driver, ends the run after that batch.
    """
    spark = docs.sparkSession
    run = f"{time.time_ns() // 1_000_000:015d}-{uuid.uuid4().hex[:12]}"
    chunks = run_chunks(docs, max_chars, overlap_chars)
    known = completed_chunks(chunks, path)
    if known is not None:
        known = checkpointed(known)
        _store_events(_events(known.join(chunks.select(*CHUNK_KEY), CHUNK_KEY, "left_semi"), run, "resumed"), path, run, 0)
        chunks = pending_chunks(chunks, known)
    requests = f"{path}/requests/{run}"
    with small_batches(spark):
        chunks.write.option("maxRecordsPerFile", batch_chunks).parquet(requests)

    def step(batch: DataFrame, batch_id: int) -> None:
        name = f"{run}-{batch_id + 1:06d}"
        done = generate_for_chunks(batch, generator, max_attempts, CHUNK_KEY)
        for table, rows in (("items", done.items), ("responses", done.responses), ("failures", done.failures), ("messages", done.parse_errors)):
            with small_batches(batch.sparkSession):
                rows.write.mode("overwrite").parquet(f"{path}/{table}/batch={name}")
        failures = batch.sparkSession.read.parquet(f"{path}/failures/batch={name}")
        finished = batch.select(*CHUNK_KEY).join(failures, CHUNK_KEY, "left_anti")
        _store_events(_batch_events(run, batch, done, finished), path, run, batch_id + 1)
        marker = finished.select(*CHUNK_KEY, F.lit(SCHEMA_VERSION).alias("schema_version"), F.unix_millis(F.current_timestamp()).alias("updated_at"))
        marker.write.mode("overwrite").parquet(f"{path}/completed/batch={name}")
        if on_batch is not None:
            on_batch(batch_id)

    files = len(spark.read.schema(chunks.schema).parquet(requests).inputFiles())
    taken = max(files_per_batch, -(-files // MOST_BATCHES))
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", taken).parquet(requests)
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/streams/{run}").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException as failure:
        sessions = chunks.select("session_id").distinct()
        _store_events(_events(sessions, run, "error", message=F.lit(str(failure).split("\n")[0][:200]), chunk=F.lit(None)), path, run, 999_998)
        raise
    return run


def stored_run(docs: DataFrame, path: str, max_chars: int = 6000, overlap_chars: int = 240) -> ChunkedRun:
    """What all runs so far have stored for ``docs``: items, responses and messages by marker, and the last failure of chunks without one."""
    spark = docs.sparkSession
    chunks = run_chunks(docs, max_chars, overlap_chars)
    markers = completed_chunks(chunks, path)
    if markers is None:
        raise ValueError(f"no run has stored a batch under {path}")
    markers = checkpointed(markers)
    by_marker = lambda name: _stored(spark, path, name).join(markers, [*CHUNK_KEY, "batch"], "left_semi").drop("batch")
    failures = pending_chunks(_stored(spark, path, "failures"), markers).join(chunks.select(*CHUNK_KEY), CHUNK_KEY, "left_semi")
    last = failures.join(failures.groupBy(*CHUNK_KEY).agg(F.max("batch").alias("batch")), [*CHUNK_KEY, "batch"]).drop("batch")
    return ChunkedRun(chunks, by_marker("responses"), by_marker("items"), last, by_marker("messages"))


def stored_calls(docs: DataFrame, path: str, max_chars: int = 6000, overlap_chars: int = 240) -> DataFrame:
    """calls: how many first requests every chunk of ``docs`` has answers for, over all runs and batches, finished or not."""
    answers = _stored(docs.sparkSession, path, "responses").filter("stage = 1")
    mine = run_chunks(docs, max_chars, overlap_chars).select(*CHUNK_KEY)
    return answers.join(mine, CHUNK_KEY, "left_semi").groupBy(*CHUNK_KEY).agg(F.count("*").alias("calls"))


def stored_records(docs: DataFrame, path: str, max_chars: int = 6000, overlap_chars: int = 240, created_at: Column | None = None) -> DataFrame:
    """Scored records of everything stored for ``docs``, before deduplication."""
    done = stored_run(docs, path, max_chars, overlap_chars)
    placed = order_items(done.items, done.chunks, CHUNK_KEY)
    return build_records(bind_to_chunks(placed, done.chunks.drop("chunk_index", "chunk_total"), *CHUNK_KEY), created_at)


def finish_run(docs: DataFrame, path: str, run: str, max_chars: int = 6000, overlap_chars: int = 240, created_at: Column | None = None) -> DataFrame:
    """Kept records of everything stored for ``docs``, deduplicated per session, with the closing events of ``run``: dedup and done per session."""
    records = checkpointed(stored_records(docs, path, max_chars, overlap_chars, created_at))
    kept, _ = dedup.deduplicate_records(records, "session_id")
    kept = checkpointed(kept)
    count = lambda df, name: df.groupBy("session_id").agg(F.count("*").alias(name))
    totals = count(records, "total").join(count(kept, "kept"), "session_id", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    nothing = F.lit(None)
    closing = _events(totals, run, "dedup", F.lit(1), F.col("total") - F.col("kept"), chunk=nothing).unionByName(_events(totals, run, "done", F.lit(2), F.col("kept"), chunk=nothing))
    _store_events(closing, path, run, 999_999)
    return kept


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """All events so far, in the order of (run, seq) within a session."""
    return spark.read.option("basePath", f"{path}/events").schema(EVENT).parquet(f"{path}/events/batch=*")


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of a run as a stream, as its batches store them."""
    return spark.readStream.schema(EVENT).parquet(f"{path}/events/batch=*")
