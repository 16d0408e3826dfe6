"""Request tables for the generator: one row per call, built from document and chunk columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from quillset.operators.chunking import MAX_CHARS, OVERLAP_CHARS, chunk_documents

# Limits and sampling settings per request kind.
SINGLE_TEXT_CHARS = 80_000
SINGLE_TEMPERATURE, CHUNK_TEMPERATURE = 0.3, 0.2
CHUNK_MAX_TOKENS, CONTINUATION_MAX_TOKENS = 16_384, 8_192
CONTINUATION_QUESTIONS = 80
NO_HEADING = "(none)"
FILE_TYPE_NAMES = {
    "pdf": "PDF",
    "docx": "word processor",
    "pptx": "slides",
    "txt": "plain text",
    "md": "Markdown",
    "html": "web page",
}

OUTPUT_SHAPE = '{"items": [{"instruction": "...", "input": "", "output": "..."}]}'
CHUNK_SYSTEM = (
    "You are given one part of a longer text. Imagine a reader who has not seen it: what could they ask that this part answers on its own? "
    f"Write those exchanges as {OUTPUT_SHAPE}; the reply is parsed by a program. An answer that this part does not support is worse than none, "
    "so an empty list is fine."
)
CONTINUE_SYSTEM = (
    f"The part below was already asked about; the earlier questions follow it. Look for answers they did not reach and reply with {OUTPUT_SHAPE}. "
    "Reply with an empty list if they reached all."
)
DOCUMENT_SYSTEM = (
    f"Read the whole text and write training exchanges about it as {OUTPUT_SHAPE}, in the text's own language. Mix short and long answers and "
    "choose whatever requests suit this text; each must be answerable by someone who has only the text."
)
EXHAUSTIVE_SYSTEM = (
    f"List every fact of the passage as an instruction and its answer. Reply with one JSON object shaped like {OUTPUT_SHAPE}."
)
QUESTION_SYSTEM = f"Write factual questions about the document with short exact answers. Reply with JSON shaped like {OUTPUT_SHAPE}."
SUMMARY_SYSTEM = f"Write summarising tasks for the document and its parts with their summaries. Reply with JSON shaped like {OUTPUT_SHAPE}."
EXTRACTION_SYSTEM = f"Write tasks that extract names, numbers, dates and terms from the document. Reply with JSON shaped like {OUTPUT_SHAPE}."

BUILTIN_TEMPLATES = (
    ("default", "General", "Mixed task types over the whole document", DOCUMENT_SYSTEM),
    ("qa", "Questions", "Questions with short answers", QUESTION_SYSTEM),
    ("summary", "Summaries", "Summarising tasks", SUMMARY_SYSTEM),
    ("extraction", "Extraction", "Structured facts from the text", EXTRACTION_SYSTEM),
)
TEMPLATE_SCHEMA = StructType(
    [
        StructField("template_id", StringType(), False),
        StructField("name", StringType()),
        StructField("description", StringType()),
        StructField("system_prompt", StringType()),
        StructField("is_builtin", BooleanType()),
        StructField("created_at", LongType()),
    ]
)


def all_templates(spark: SparkSession, custom: DataFrame | None = None) -> DataFrame:
    builtin = spark.createDataFrame([(*t, True, 0) for t in BUILTIN_TEMPLATES], TEMPLATE_SCHEMA)
    return builtin if custom is None else builtin.unionByName(custom)


def file_type_name(file_type: Column) -> Column:
    names = F.create_map(*[F.lit(item) for pair in FILE_TYPE_NAMES.items() for item in pair])
    return F.coalesce(F.try_element_at(names, file_type), file_type)


def _request(system: Column, user: Column, temperature: float, max_tokens: int | None) -> Column:
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.struct(
        F.lit("").alias("model"),
        F.array(message("system", system), message("user", user)).alias("messages"),
        F.lit(temperature).alias("temperature"),
        F.lit(max_tokens).cast("int").alias("max_tokens"),
        F.lit("json_object").alias("response_format"),
    )


def document_parts(docs: DataFrame, limit: int | None = SINGLE_TEXT_CHARS, max_chars: int = MAX_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """Documents as what one request can hold: those of at most ``limit`` characters whole, longer ones as their chunks.
    Without a ``limit`` (a generator that takes any length) every document stays whole.

    Adds ``part_no``, ``part_total`` and ``heading`` (1, 1 and null for a whole document); ``text`` becomes the part's text. Nothing
    is cut off: the chunks of a document cover it. A null text gives one part without text.
    """
    columns = docs.columns
    one = F.lit(1).cast("bigint")
    undivided = {"part_no": one, "part_total": one, "heading": F.lit(None).cast("string")}
    if limit is None:
        return docs.withColumns(undivided)
    # Long texts only are looked into; the other branch keeps its rows as they are, so neither side shuffles.
    long = docs.filter(F.length("text") > limit)
    keys = [c for c in columns if c != "text"]
    chunks = chunk_documents(long, *keys, max_chars=max_chars, overlap_chars=overlap_chars)
    parts = chunks.select(*columns, F.col("chunk_index").alias("part_no"), F.col("chunk_total").alias("part_total"), "heading")
    whole = docs.filter(F.coalesce(F.length("text") <= limit, F.lit(True))).withColumns(undivided)
    return whole.unionByName(parts)


def _part_user(lead: Column) -> Column:
    """Name, type and length of the document, which part of it follows when it has several, and that part's text."""
    part = F.when(
        F.col("part_total") > 1,
        F.concat(
            F.lit("Part: "),
            F.col("part_no").cast("string"),
            F.lit("/"),
            F.col("part_total").cast("string"),
            F.lit("\nHeading: "),
            F.coalesce(F.when(F.col("heading") != "", F.col("heading")), F.lit(NO_HEADING)),
            F.lit("\n"),
        ),
    ).otherwise("")
    return F.concat(
        lead,
        F.lit("Name: "),
        F.col("source_name"),
        F.lit("\nType: "),
        file_type_name(F.col("file_type")),
        F.lit("\nCharacters: "),
        F.col("char_count").cast("string"),
        F.lit("\n"),
        part,
        F.lit("\n<source>\n"),
        F.coalesce("text", F.lit("")),
        F.lit("\n</source>"),
    )


def single_requests(
    docs: DataFrame, templates: DataFrame | None = None, template_id: str = "default", limit: int = SINGLE_TEXT_CHARS
) -> DataFrame:
    """A request per document with the system prompt of the chosen template; documents over ``limit`` characters get one per part."""
    lead = F.lit("Build the dataset from this document.\n")
    parts = document_parts(docs, limit)
    if templates is None:
        return parts.withColumn("request", _request(F.lit(DOCUMENT_SYSTEM), _part_user(lead), SINGLE_TEMPERATURE, None))
    # Exactly one template row is selected, so the broadcast side is a single row.
    chosen = F.broadcast(templates.filter(F.col("template_id") == template_id).limit(1).select("template_id", "system_prompt"))
    joined = parts.withColumn("template_id", F.lit(template_id)).join(chosen, "template_id")
    request = _request(F.col("system_prompt"), _part_user(lead), SINGLE_TEMPERATURE, None)
    return joined.withColumn("request", request).drop("system_prompt")


def deep_requests(parts: DataFrame, round_no: Column, existing_count: Column) -> DataFrame:
    """Requests of a multi-round run, one per part of a document (``document_parts``).

    The first round asks for everything, later ones for what is still missing.
    """
    more = F.concat(
        F.lit("Round "), round_no.cast("string"), F.lit(": "), existing_count.cast("string"), F.lit(" items exist already; find different ones.\n")
    )
    lead = F.when(round_no <= 1, F.lit("Build the dataset from this document.\n")).otherwise(more)
    system = F.when(round_no <= 1, F.lit(DOCUMENT_SYSTEM)).otherwise(F.lit(CONTINUE_SYSTEM))
    return parts.withColumn("request", _request(system, _part_user(lead), SINGLE_TEMPERATURE, None))


def chunk_requests(chunks: DataFrame, temperature: float = CHUNK_TEMPERATURE) -> DataFrame:
    """One request per chunk. ``chunks`` carries the document's ``source_name``."""
    user = F.concat(
        F.lit("Document: "),
        F.col("source_name"),
        F.lit("\nPart: "),
        F.col("chunk_index").cast("string"),
        F.lit("/"),
        F.col("chunk_total").cast("string"),
        F.lit("\nHeading: "),
        F.coalesce(F.when(F.col("heading") != "", F.col("heading")), F.lit(NO_HEADING)),
        F.lit("\n\n<source>\n"),
        F.col("text"),
        F.lit("\n</source>"),
    )
    return chunks.withColumn("request", _request(F.lit(CHUNK_SYSTEM), user, temperature, CHUNK_MAX_TOKENS))


def continuation_requests(
    chunks: DataFrame, items: DataFrame, *keys: str, temperature: float = CHUNK_TEMPERATURE, listed: int = CONTINUATION_QUESTIONS
) -> DataFrame:
    """Requests for chunks whose answer was cut off, listing the last ``listed`` questions already received.

    ``items`` has the keys, ``item_no`` and ``instruction``; only the listed rows per chunk are collected.
    """
    from pyspark.sql import Window

    newest = Window.partitionBy(*keys).orderBy(F.desc("item_no"))
    last = items.withColumn("__n", F.row_number().over(newest)).filter(F.col("__n") <= listed)
    asked = last.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("item_no", "instruction"))).alias("__asked"))
    user = F.concat(
        F.lit("Document: "),
        F.col("source_name"),
        F.lit("\nHeading: "),
        F.coalesce(F.when(F.col("heading") != "", F.col("heading")), F.lit(NO_HEADING)),
        F.lit("\nQuestions so far:\n"),
        F.array_join(F.transform("__asked", lambda a: a["instruction"]), "\n"),
        F.lit("\n\n<source>\n"),
        F.col("text"),
        F.lit("\n</source>"),
    )
    joined = chunks.join(asked, list(keys))
    return joined.withColumn("request", _request(F.lit(CONTINUE_SYSTEM), user, temperature, CONTINUATION_MAX_TOKENS)).drop("__asked")


def paragraph_chunk_requests(chunks: DataFrame, temperature: float = SINGLE_TEMPERATURE) -> DataFrame:
    """Requests of the older chunked run."""
    heading = F.when(F.coalesce(F.col("heading"), F.lit("")) != "", F.concat(F.lit("\nHeading: "), "heading")).otherwise("")
    user = F.concat(
        F.lit("Document: "),
        F.col("source_name"),
        F.lit("\nType: "),
        file_type_name(F.col("file_type")),
        F.lit("\nCharacters: "),
        F.col("char_count").cast("string"),
        F.lit("\nPart: "),
        F.col("chunk_index").cast("string"),
        F.lit("/"),
        F.col("chunk_total").cast("string"),
        heading,
        F.lit("\n\n<source>\n"),
        F.col("text"),
        F.lit("\n</source>"),
    )
    return chunks.withColumn("request", _request(F.lit(EXHAUSTIVE_SYSTEM), user, temperature, None))


def route_by_size(docs: DataFrame, limit: int = SINGLE_TEXT_CHARS) -> tuple[DataFrame, DataFrame]:
    """(single-request documents, documents to be chunked)."""
    return docs.filter(F.col("char_count") <= limit), docs.filter(F.col("char_count") > limit)
