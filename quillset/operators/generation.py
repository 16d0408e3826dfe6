"""Generation runs over request tables with a caller-supplied generator.

A generator is a function ``batch -> rows`` for ``mapInPandas``: it receives a pandas frame with ``system``, ``user``, ``temperature`` and
``max_tokens`` and returns one (raw_content, finish_reason, prompt_tokens, completion_tokens, error) per row, ``error`` being null on
success. It runs in the tasks, so calls are spread by Spark; its results are checkpointed, so a lost executor never repeats
a finished call.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quillset.functions.text import is_blank
from quillset.operators import dedup, requests, responses
from quillset.operators.chunking import chunk_documents, chunk_documents_by_paragraph
from quillset.operators.evidence import bind_to_chunks
from quillset.operators.quality import build_records
from quillset.session import checkpointed

Generator = Callable[[pd.DataFrame], Sequence[tuple]]

# Attempts per chunk, rounds and separators.
MAX_ATTEMPTS, MAX_ROUNDS = 3, 5
MESSAGE_SEPARATOR = "；"
RESPONSE_FIELDS = (
    StructField("raw_content", StringType()),
    StructField("finish_reason", StringType()),
    StructField("prompt_tokens", LongType()),
    StructField("completion_tokens", LongType()),
    StructField("error", StringType()),
)


def run_generator(request_rows: DataFrame, generator: Generator, *keys: str) -> DataFrame:
    """Call the generator on every request; returns the keys and the response columns."""
    prompts = request_rows.select(
        *keys,
        F.col("request.messages")[0]["content"].alias("system"),
        F.col("request.messages")[1]["content"].alias("user"),
        F.col("request.temperature").alias("temperature"),
        F.col("request.max_tokens").alias("max_tokens"),
    )
    key_columns = list(keys)
    schema = StructType([StructField(f.name, f.dataType) for f in prompts.schema if f.name in keys] + list(RESPONSE_FIELDS))
    names = [f.name for f in RESPONSE_FIELDS]

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answered = pd.DataFrame(list(generator(batch)), columns=names, index=batch.index)
            answered = answered.astype({"prompt_tokens": "Int64", "completion_tokens": "Int64"})
            yield pd.concat([batch[key_columns], answered], axis=1)

    return prompts.mapInPandas(call, schema)


def rule_based_generator(batch: pd.DataFrame) -> list[tuple]:
    """Deterministic stand-in for a model: asks for the heading or first sentence, answers with the longest sentence."""
    rows = []
    for user in batch["user"]:
        source = user.split("<source>\n", 1)[1].rsplit("\n</source>", 1)[0]
        sentences = [s.strip() for s in re.split(r"[.!?。！？\n]", source) if s.strip()]
        if not sentences:
            rows.append(('{"items": []}', "stop", len(user) // 4, 3, None))
            continue
        question = re.sub(r"^#+\s*", "", sentences[0])
        item = {"instruction": question or sentences[0], "input": "", "output": max(sentences, key=len)}
        raw = json.dumps({"items": [item]}, ensure_ascii=False)
        rows.append((raw, "stop", len(user) // 4, len(raw) // 4, None))
    return rows


@dataclass
class ChunkedRun:
    """Tables of one run: everything but ``records`` is keyed by document and chunk."""

    chunks: DataFrame
    responses: DataFrame
    items: DataFrame
    failures: DataFrame
    parse_errors: DataFrame


KEYS = ("document_id", "chunk_id")
# A document_id has 32 bits, so among many documents two may share one: whole runs number their documents and join on that.
DOCUMENT_KEYS = ("document_no", *KEYS)


def numbered_documents(docs: DataFrame) -> DataFrame:
    """Add ``document_no``, fixed once the chunks cut from it are checkpointed."""
    return docs.withColumn("document_no", F.monotonically_increasing_id())


def placed_in_document(items: DataFrame) -> DataFrame:
    """Add ``place``: 1, 2, ... by ``pos`` within a document_id, so that documents sharing one still have a place for each item."""
    order = Window.partitionBy("document_id").orderBy("pos", "document_no")
    return items.withColumn("place", F.row_number().over(order).cast("bigint"))


def generate_for_chunks(chunks: DataFrame, generator: Generator, max_attempts: int = MAX_ATTEMPTS, keys: Sequence[str] = KEYS) -> ChunkedRun:
    """Up to ``max_attempts`` calls per chunk, a continuation after a cut-off answer, failures kept as rows.

    An attempt fails when a call fails, or nothing usable came back and parsing complained. All chunks advance together: one
    attempt is one pass over those still open. Messages of failed attempts are kept with their attempt number. ``keys`` identify a chunk.
    """
    open_chunks = chunks
    parts: dict[str, DataFrame | None] = {"responses": None, "items": None, "errors": None}

    def add(name: str, df: DataFrame) -> None:
        parts[name] = df if parts[name] is None else parts[name].unionByName(df)

    failed = None
    for attempt in range(1, max_attempts + 1):
        calls = run_generator(requests.chunk_requests(open_chunks), generator, *keys)
        first = checkpointed(calls.withColumns({"attempt": F.lit(attempt), "stage": F.lit(1)}))
        summary = checkpointed(responses.parse_summary(first.filter("error IS NULL"), *keys))
        usable = summary.filter("valid_count > 0 OR size(parse_errors) = 0")
        first_items = responses.valid_items(
            responses.parse_items(first.join(usable.select(*keys), list(keys), "left_semi"), *keys)
        )
        cut = first.filter("finish_reason = 'length'").join(usable.filter("valid_count > 0").select(*keys), list(keys), "left_semi")
        again = requests.continuation_requests(
            open_chunks.join(cut.select(*keys), list(keys), "left_semi"),
            first_items.join(cut.select(*keys), list(keys), "left_semi"),
            *keys,
        )
        second = checkpointed(
            run_generator(again, generator, *keys).withColumns({"attempt": F.lit(attempt), "stage": F.lit(2)})
        )
        done = usable.select(*keys).join(second.filter("error IS NOT NULL").select(*keys), list(keys), "left_anti")
        more_items = responses.valid_items(responses.parse_items(second.filter("error IS NULL"), *keys))
        items = first_items.withColumn("stage", F.lit(1)).unionByName(more_items.withColumn("stage", F.lit(2)))
        add("items", items.join(done, list(keys), "left_semi"))
        add("responses", first.unionByName(second))
        warned = summary.withColumn("stage", F.lit(1)).unionByName(
            responses.parse_summary(second.filter("error IS NULL"), *keys).withColumn("stage", F.lit(2))
        )
        add("errors", warned.select(*keys, F.lit(attempt).alias("attempt"), "stage", F.explode("parse_errors").alias("message")))
        reasons = first.unionByName(second).filter("error IS NOT NULL").select(*keys, F.col("error").alias("message"))
        complaints = summary.filter("valid_count = 0 AND size(parse_errors) > 0").select(
            *keys, F.array_join("parse_errors", MESSAGE_SEPARATOR).alias("message")
        )
        failed = checkpointed(reasons.unionByName(complaints))
        if failed.isEmpty():
            break
        open_chunks = open_chunks.join(failed.select(*keys).distinct(), list(keys), "left_semi")
    failures = failed.join(chunks.select(*keys, "heading"), list(keys)).withColumn("attempts", F.lit(max_attempts))
    return ChunkedRun(chunks, parts["responses"], parts["items"], failures, parts["errors"])


def order_items(items: DataFrame, chunks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Give every item its position within the document: chunk, then first response, then continuation."""
    numbered = items.join(chunks.select(*keys, "chunk_index"), list(keys))
    return numbered.withColumn(
        "pos", F.col("chunk_index") * 10_000_000 + F.col("stage") * 1_000_000 + F.col("item_no")
    ).drop("chunk_index", "stage", "item_no", "strategy")


def extract_records(
    docs: DataFrame,
    generator: Generator,
    max_chars: int = 6000,
    overlap_chars: int = 240,
    created_at=None,
) -> tuple[DataFrame, ChunkedRun]:
    """Documents to scored records before deduplication, in one go; ``operators.resume`` does the same in batches that survive an interruption.

    ``place`` orders the records of a document_id, ``document_no`` tells documents apart that share one.
    """
    keys = ("document_no", "document_id", "source_name", "file_type")
    chunks = chunk_documents(numbered_documents(docs), *keys, max_chars=max_chars, overlap_chars=overlap_chars)
    # Read by the calls, their continuations and the evidence join: cut once.
    chunks = checkpointed(chunks)
    run = generate_for_chunks(chunks, generator, keys=DOCUMENT_KEYS)
    placed = placed_in_document(order_items(run.items, chunks, DOCUMENT_KEYS))
    bound = bind_to_chunks(placed, chunks.drop("chunk_index", "chunk_total"), *DOCUMENT_KEYS)
    return build_records(bound, created_at), run


def run_totals(run: ChunkedRun, records: DataFrame, kept: DataFrame) -> DataFrame:
    """Per document: chunks, records before and after deduplication, removed, failed chunks, warnings and tokens."""
    by_doc = lambda df, **aggs: df.groupBy("document_id").agg(*[v.alias(k) for k, v in aggs.items()])
    document = F.col("source.document_id").alias("document_id")
    totals = by_doc(run.chunks, total_chunks=F.count("*"))
    parts = [
        by_doc(records.select(document), total_before_dedup=F.count("*")),
        by_doc(kept.select(document), total_after_dedup=F.count("*")),
        by_doc(run.failures.select(*DOCUMENT_KEYS).distinct(), failed_chunks=F.count("*")),
        by_doc(run.parse_errors, parse_warnings=F.count("*")),
        by_doc(
            run.responses,
            prompt_tokens=F.sum(F.coalesce("prompt_tokens", F.lit(0))),
            completion_tokens=F.sum(F.coalesce("completion_tokens", F.lit(0))),
        ),
    ]
    for part in parts:
        totals = totals.join(part, "document_id", "left")
    filled = totals.fillna(0)
    return filled.withColumn("dedup_removed", F.col("total_before_dedup") - F.col("total_after_dedup"))


def _session_answers(calls: DataFrame) -> DataFrame:
    """The calls of each session's round as one answer: failed when any failed, finished when all parts are, tokens added up."""
    finished = F.coalesce("finish_reason", F.lit("")) == "stop"
    return calls.groupBy("session_id").agg(
        F.min("error").alias("error"),
        F.when(F.bool_and(finished), F.lit("stop")).otherwise(F.min(F.when(~finished, F.col("finish_reason")))).alias("finish_reason"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
    )


def deep_rounds(
    docs: DataFrame,
    generator: Generator,
    max_rounds: int = MAX_ROUNDS,
    threshold: float = dedup.ROUND_THRESHOLD,
    history: DataFrame | None = None,
    compare_with: str = "previous",
    limit: int | None = requests.SINGLE_TEXT_CHARS,
) -> tuple[DataFrame, DataFrame]:
    """Repeat generation per session until it is exhausted; all active sessions share each round's job.

    ``docs`` has a unique session_id and the document columns; ``history`` resumes from (session_id, round, item_no, instruction, input, output).
    A document over ``limit`` characters is asked about part by part in every round, none is without a ``limit``. Returns (items, rounds); ``rounds`` says in ``stop_reason``
    why a session ended with that round, null where it went on:

    * ``failed``: a call failed, ``error`` holds its message. Nothing of that round is kept, and the session stays open: a later run
      with the items so far as ``history`` begins with the same round.
    * ``exhausted``: the round added nothing.
    * ``finished``: the generator said so for every part.
    * ``repeated``: a round from the second on is on average more similar than ``threshold`` to the previous one
      (``compare_with="self"`` compares it with itself when the previous round was not loaded from history).
    * ``round_limit``: it was round ``max_rounds``.
    """
    columns = ["session_id", "round", "item_no", "instruction", "input", "output"]
    items = docs.select("session_id").limit(0).selectExpr(
        "session_id", "0 AS round", "0L AS item_no", "'' AS instruction", "'' AS input", "'' AS output"
    )
    if history is not None:
        items = items.unionByName(history.select(*columns))
    items = checkpointed(items)
    past = items.groupBy("session_id").agg(F.max("round").alias("last"), F.count("*").alias("n"))
    # Texts are cut into parts once; from round to round only (session, round, number of items) changes.
    parts = checkpointed(requests.document_parts(docs, limit))
    active = checkpointed(
        docs.select("session_id")
        .join(past, "session_id", "left")
        .select("session_id", (F.coalesce("last", F.lit(0)) + 1).alias("round"), F.coalesce("n", F.lit(0)).alias("n"))
        .filter(F.col("round") <= max_rounds)
    )
    resumed = items
    rounds = None
    in_answer = Window.partitionBy("session_id", "round").orderBy("part_no", "item_no")
    while not active.isEmpty():
        asked = requests.deep_requests(parts.join(active, "session_id"), F.col("round"), F.col("n"))
        calls = checkpointed(run_generator(asked, generator, "session_id", "round", "part_no"))
        answered = checkpointed(_session_answers(calls))
        whole = calls.join(answered.filter("error IS NOT NULL").select("session_id"), "session_id", "left_anti")
        found = responses.valid_items(responses.parse_items(whole, "session_id", "round", "part_no")).drop("strategy")
        numbered = found.withColumn("item_no", F.row_number().over(in_answer).cast("bigint")).drop("part_no")
        new = checkpointed(dedup.drop_known(numbered, items, "session_id", threshold=threshold))
        log = active.join(new.groupBy("session_id").agg(F.count("*").alias("valid_count")), "session_id", "left").join(answered, "session_id", "left")
        log = log.withColumn("valid_count", F.coalesce("valid_count", F.lit(0)))
        before = active.select("session_id", (F.col("round") - 1).alias("round"))
        previous = (resumed if compare_with == "self" else items).join(before, ["session_id", "round"])
        if compare_with == "self":
            own = new.join(previous.select("session_id").distinct(), "session_id", "left_anti")
            previous = previous.select(*columns).unionByName(own.select(*columns))
        similar = dedup.average_similarity(new, previous, "session_id")
        repeated = (F.col("round") > 1) & (F.coalesce("avg_similarity", F.lit(0.0)) > threshold)
        reason = (
            F.when(F.col("error").isNotNull(), "failed")
            .when(F.col("valid_count") == 0, "exhausted")
            .when(F.col("finish_reason") == "stop", "finished")
            .when(repeated, "repeated")
            .when(F.col("round") >= max_rounds, "round_limit")
        )
        log = checkpointed(
            log.join(similar, "session_id", "left").select(
                "session_id",
                "round",
                "valid_count",
                (F.col("n") + F.col("valid_count")).alias("total_items"),
                F.when(F.col("error").isNull(), F.col("finish_reason")).alias("finish_reason"),
                "prompt_tokens",
                "completion_tokens",
                "avg_similarity",
                "error",
                reason.alias("stop_reason"),
            )
        )
        rounds = log if rounds is None else rounds.unionByName(log)
        items = checkpointed(items.unionByName(new.select(*columns)))
        active = checkpointed(
            log.filter("stop_reason IS NULL").select("session_id", (F.col("round") + 1).alias("round"), F.col("total_items").alias("n"))
        )
    return items, rounds


def extract_items_by_paragraph(
    docs: DataFrame, generator: Generator, max_chars: int = 6000, overlap_chars: int = 200, threshold: float = dedup.ITEM_THRESHOLD
) -> tuple[DataFrame, DataFrame]:
    """The older run: paragraph chunks, one call each, longer answers win. Returns (items, failures).

    A failed call fails its whole document, which then has no items but a row (document_id, failed_calls, error) in ``failures``, with the smallest
    of its messages; other documents go on.
    """
    keys = ("document_no", "document_id", "source_name", "file_type", "char_count")
    chunks = checkpointed(chunk_documents_by_paragraph(numbered_documents(docs), *keys, max_chars=max_chars, overlap_chars=overlap_chars))
    answered = checkpointed(run_generator(requests.paragraph_chunk_requests(chunks), generator, *DOCUMENT_KEYS))
    broken = answered.filter("error IS NOT NULL")
    failures = broken.groupBy("document_no", "document_id").agg(F.count("*").alias("failed_calls"), F.min("error").alias("error")).drop("document_no")
    whole = answered.join(broken.select("document_no").distinct(), "document_no", "left_anti")
    items = responses.valid_items(responses.parse_items(whole, *DOCUMENT_KEYS)).filter(~is_blank(F.col("instruction")))
    placed = placed_in_document(order_items(items.withColumn("stage", F.lit(1)), chunks, DOCUMENT_KEYS))
    return dedup.longer_answer_wins(placed, "document_id", position="place", threshold=threshold), failures
