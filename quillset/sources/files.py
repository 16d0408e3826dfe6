"""Document sources: file listings, plain text, Markdown, HTML and slide archives."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillset.functions.html import clean_text, paragraph_count, strip_html
from quillset.functions.text import base36_hash, computed_once, is_blank

# Accepted extensions with the type each stands for, and the upload limit in bytes.
FILE_TYPES = {
    "pdf": "pdf",
    "docx": "docx",
    "pptx": "pptx",
    "ppt": "pptx",
    "txt": "txt",
    "md": "md",
    "markdown": "md",
    "html": "html",
    "htm": "html",
}
MAX_FILE_BYTES = 10 * 1024 * 1024
NO_SLIDES = "[注意：未能找到 PPTX 中的幻灯片内容。]"
NO_SLIDE_TEXT = "[注意：PPTX 中未提取到文本内容。]"


def extension_of(file_name: Column) -> Column:
    return F.lower(F.element_at(F.split(file_name, "[.]", -1), -1))


def infer_file_type(file_name: Column) -> Column:
    """File type from the last dot-suffix; null when the extension is not accepted."""
    mapping = F.create_map(*[F.lit(item) for pair in FILE_TYPES.items() for item in pair])
    return F.try_element_at(mapping, extension_of(file_name))


def gate_uploads(files: DataFrame, name: str = "file_name", size: str = "file_size") -> DataFrame:
    """Add ``file_type`` and ``reject_reason`` (null when accepted); the size limit is checked first."""
    return files.withColumn("file_type", infer_file_type(F.col(name))).withColumn(
        "reject_reason",
        F.when(F.col(size) > MAX_FILE_BYTES, F.lit("too_large")).when(
            F.col("file_type").isNull(), F.lit("unsupported_type")
        ),
    )


def reject_empty(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split documents into those with text and those without."""
    blank = is_blank(F.col("text"))
    return docs.filter(~blank), docs.filter(blank)


def with_document_columns(docs: DataFrame) -> DataFrame:
    """From (source_name, file_type, text) to the document relation with stats and a stable id."""
    return docs.withColumns(
        {"char_count": F.length("text").cast("bigint"), "paragraph_count": paragraph_count(F.col("text"))}
    ).withColumn("document_id", document_id())


def document_id() -> Column:
    head = F.substring("text", 1, 512)
    return F.concat(
        F.lit("doc_"), base36_hash(F.concat_ws("|", "source_name", "file_type", F.col("char_count").cast("string"), head))
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """List files with their bytes; oversize files are dropped by the scan before their content is read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .withColumn("file_name", F.element_at(F.split("path", "/"), -1))
    )
    return gate_uploads(files, size="length")


def documents_from_files(files: DataFrame) -> DataFrame:
    """One row per file of (path, length, content): a document, or why there is none.

    Adds source_name, file_type and, for documents, text and the document columns; ``reject_reason`` is null for those and otherwise one of
    ``too_large``, ``unsupported_type``, ``needs_converter`` (page-based and word-processor binaries: feed their pages through
    :func:`quillset.sources.pages.assemble_pages`, their HTML through :func:`strip_html`), ``unreadable`` (with ``message``) and ``empty``.
    The bytes of files rejected by size or type are not read.
    """
    named = gate_uploads(files.withColumn("file_name", F.element_at(F.split("path", "/"), -1)), size="length")
    named = named.withColumn(
        "reject_reason", F.coalesce("reject_reason", F.when(F.col("file_type").isin("pdf", "docx"), F.lit("needs_converter")))
    )
    none = F.lit(None).cast("string")
    head = ["path", F.col("file_name").alias("source_name"), "file_type"]
    refused = named.filter(F.col("reject_reason").isNotNull()).select(*head, none.alias("text"), "reject_reason", none.alias("message"))
    # The size stands alone in a filter of its own: the scan then leaves larger files unopened.
    taken = named.filter(F.col("length") <= MAX_FILE_BYTES).filter(F.col("reject_reason").isNull())
    decoded = F.decode("content", "UTF-8")
    texts = taken.filter(F.col("file_type") != "pptx").select(
        *head, F.when(F.col("file_type") == "html", strip_html(decoded)).otherwise(decoded).alias("text"), none.alias("message")
    )
    decks = taken.filter(F.col("file_type") == "pptx").select("path", "file_name", "content")
    slides = assemble_slides(read_slide_paragraphs(decks)).select(
        "path", F.element_at(F.split("path", "/"), -1).alias("source_name"), F.lit("pptx").alias("file_type"), "text", "message"
    )
    read = computed_once(texts.unionByName(slides), "text", clean_text(F.col("text")))
    reason = F.when(F.col("message").isNotNull(), "unreadable").when(is_blank(F.coalesce("text", F.lit(""))), "empty")
    judged = read.withColumn("reject_reason", reason).withColumn("text", F.when(F.col("reject_reason").isNull(), F.col("text")))
    rows = with_document_columns(refused.unionByName(judged))
    kept = F.col("reject_reason").isNull()
    return rows.withColumns({c: F.when(kept, F.col(c)) for c in ("char_count", "paragraph_count", "document_id")})


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Every file under ``path`` as a row of ``documents_from_files``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return documents_from_files(files.select("path", "length", "content"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Text, Markdown, HTML and slide files under ``path`` as one document relation; ``read_uploads`` tells what became of the others."""
    return read_uploads(spark, path).filter(F.col("reject_reason").isNull()).drop("reject_reason", "message")


def read_slide_paragraphs(files: DataFrame) -> DataFrame:
    """One row per slide paragraph of each archive; an archive without slides gives one row with null slide, an unreadable one a ``message`` too."""

    def slides_of(content: bytes) -> list[tuple[int, str]]:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            members = [(re.fullmatch(r"ppt/slides/slide(\d+)\.xml", name), name) for name in archive.namelist()]
            return [(int(slide.group(1)), archive.read(name).decode("utf-8", "replace")) for slide, name in members if slide]

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    slides = slides_of(content)
                except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, ValueError, OSError) as broken:
                    rows.append((path, None, None, f"{type(broken).__name__}: {broken}"))
                    continue
                rows += [(path, number, xml, None) for number, xml in slides] or [(path, None, None, None)]
            yield pd.DataFrame(rows, columns=["path", "slide_no", "xml", "message"]).astype({"slide_no": "Int64"})

    slides = files.select("path", "content").mapInPandas(unpack, "path string, slide_no bigint, xml string, message string")
    blocks = F.regexp_extract_all("xml", F.lit("(?s)<a:p[\\s>].*?</a:p>"), F.lit(0))
    runs = lambda block: F.filter(
        F.transform(F.regexp_extract_all(block, F.lit("<a:t[^>]*>([^<]*)</a:t>"), F.lit(1)), _trim), lambda run: run != ""
    )
    paragraphs = F.filter(F.transform(blocks, lambda block: F.array_join(runs(block), "")), lambda text: text != "")
    return slides.select("path", "slide_no", "message", F.posexplode_outer(paragraphs).alias("para_no", "text"))


def _trim(value: Column) -> Column:
    from quillset.functions.text import js_trim

    return js_trim(value)


def assemble_slides(paragraphs: DataFrame) -> DataFrame:
    """Rebuild each deck's text, slides by number, empty slides left out; null for an unreadable one, which keeps its ``message``.

    A deck is one uploaded file (at most 10 MiB).
    """
    ordered = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("para_no", "text"))))
    slides = paragraphs.groupBy("path", "slide_no").agg(ordered.alias("lines"), F.first("message").alias("message"))
    slide_text = F.concat(
        F.lit("=== 第 "),
        F.col("slide_no").cast("string"),
        F.lit(" 页 ===\n"),
        F.array_join(F.transform("lines", lambda line: line["text"]), "\n"),
    )
    decks = slides.groupBy("path").agg(
        F.array_sort(F.collect_list(F.when(F.size("lines") > 0, F.struct("slide_no", slide_text.alias("text"))))).alias("slides"),
        F.count("slide_no").alias("slide_count"),
        F.max("message").alias("message"),
    )
    joined = F.array_join(F.transform("slides", lambda slide: slide["text"]), "\n\n")
    return decks.select(
        "path",
        F.when(F.col("message").isNotNull(), F.lit(None))
        .when(F.col("slide_count") == 0, F.lit(NO_SLIDES))
        .when(F.size("slides") == 0, F.lit(NO_SLIDE_TEXT))
        .otherwise(joined)
        .alias("text"),
        "message",
    )
