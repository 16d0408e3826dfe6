"""Splitting documents into chunks with exact source offsets.

A document is one row from the scan to the final ``explode``: headings are found with regular expressions, section
extents are cumulative lengths inside the row, and numbering is the array position. Nothing is shuffled. Only sections
longer than the limit visit Python, for the cursor loop whose every step depends on the step before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quillset.functions.text import LINE_END, LINE_START, NOT_LINE_END, WHITESPACE, WS, explode_positions, is_blank, js_trim

# Sizes, heading patterns and sentence ends.
MAX_CHARS, OVERLAP_CHARS, MIN_MAX_CHARS, MAX_OVERLAP_SHARE = 6000, 240, 32, 0.4
BOUNDARY_WINDOW_SHARE = 0.45
PREFACE_TITLE = "前言"
HEADING = (
    f"{LINE_START}(?:#{{1,6}}{WS}+{NOT_LINE_END}+"
    f"|={{3,}}{WS}*第{WS}*[0-9]+{WS}*页{WS}*={{3,}}"
    f"|第[一二三四五六七八九十百千万0-9]+[章节篇部]{WS}*[^\\n]*){LINE_END}"
)
BREAKS = "\n。！？"
SHORT_MAX_CHARS, SHORT_OVERLAP_CHARS, MIN_BREAK_SHARE = 6000, 200, 0.3
SHORT_HEADING = f"{LINE_START}#{{1,3}}{WS}+{NOT_LINE_END}+{LINE_END}"
LOCATE_CHARS = 50

SPAN_TYPE = "array<struct<section:int,start:bigint,end:bigint,text:string>>"


def heading_title(heading: Column) -> Column:
    title = F.regexp_replace(heading, f"^#{{1,6}}{WS}+", "")
    title = F.regexp_replace(title, f"^#+{WS}*", "")
    return js_trim(F.regexp_replace(title, "^=+|=+$", ""))


def _with_raw_sections(docs: DataFrame, pattern: str) -> DataFrame:
    """Add ``__raw``: (start, end, mark, text) per section, the part before the first heading first (null mark).

    Kept as a column of its own: an expression repeated inside a lambda would be evaluated once per element.
    """
    text = F.col("text")
    marks = F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    bodies = F.zip_with(
        F.split(text, pattern, -1),
        marks,
        lambda piece, mark: F.struct(mark.alias("mark"), F.concat(F.coalesce(mark, F.lit("")), piece).alias("text")),
    )
    empty = F.array().cast("array<struct<start:bigint,end:bigint,mark:string,text:string>>")

    def place(acc: Column, body: Column) -> Column:
        end = acc["at"] + F.length(body["text"]).cast("bigint")
        row = F.struct(acc["at"].alias("start"), end.alias("end"), body["mark"].alias("mark"), body["text"].alias("text"))
        return F.struct(end.alias("at"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("rows"))
    raw = docs.withColumn("__raw", F.aggregate(bodies, start, place, lambda acc: acc["rows"]))
    return raw.withColumns({"__raw_count": F.size("__raw"), "__blank": is_blank(text)})


def _with_sections(docs: DataFrame) -> DataFrame:
    """Add ``__sections``: one per heading, a preface when non-blank, or the whole untitled text."""
    raw = _with_raw_sections(docs, HEADING)
    count = F.col("__raw_count")
    kept = F.filter("__raw", lambda s, i: (i > 0) | (count == 1) | ~is_blank(s["text"]))
    titled = F.transform(
        kept,
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.when(s["mark"].isNotNull(), heading_title(s["mark"])).when(count > 1, F.lit(PREFACE_TITLE)).alias("heading"),
            s["text"].alias("text"),
        ),
    )
    return raw.withColumn("__sections", F.when(~F.col("__blank"), titled)).drop("__raw")


def _with_short_sections(docs: DataFrame) -> DataFrame:
    """Add ``__sections`` of the older chunker: trimmed, untitled whole text when there is no heading at all."""
    raw = _with_raw_sections(docs, SHORT_HEADING)
    trimmed = F.filter(
        F.transform(
            F.filter("__raw", lambda s, i: i > 0),
            lambda s: F.struct(
                js_trim(F.regexp_replace(s["mark"], f"^#{{1,3}}{WS}+", "")).alias("heading"), js_trim(s["text"]).alias("text")
            ),
        ),
        lambda s: s["text"] != "",
    )
    whole = F.array(F.struct(F.lit(None).cast("string").alias("heading"), F.col("text").alias("text")))
    sections = F.when(F.col("__raw_count") > 1, trimmed).otherwise(whole)
    return raw.withColumn("__sections", F.when(~F.col("__blank"), sections)).drop("__raw")


def _last_break(text: str, low: int, high: int) -> int:
    return max(text.rfind(mark, low, high) for mark in BREAKS)


def _structured_spans(text: str, limit: int, overlap: int) -> Iterator[tuple[int, int]]:
    at, size = 0, len(text)
    while at < size:
        end = min(at + limit, size)
        if end < size:
            found = _last_break(text, at + int((end - at) * BOUNDARY_WINDOW_SHARE), end)
            end = max(at + 1, found + 1 if found >= 0 else end)
        yield at, end
        if end >= size:
            return
        at = max(at + 1, end - overlap)


def _short_spans(text: str, limit: int, overlap: int) -> Iterator[tuple[int, int]]:
    at, size = 0, len(text)
    while at < size:
        end = at + limit
        if end < size:
            paragraph = text.rfind("\n\n", at, end) - at
            sentence = _last_break(text, at, end) - at
            if paragraph > limit * MIN_BREAK_SHARE:
                end = at + paragraph
            elif sentence > limit * MIN_BREAK_SHARE:
                end = at + sentence + 1
        yield at, min(end, size)
        if end >= size:
            return
        at = max(end - overlap, at + 1)


def _splitter(spans: Callable[[str, int, int], Iterator[tuple[int, int]]], limit: int, overlap: int, trim: bool):
    @pandas_udf(SPAN_TYPE)
    def split_long(texts: pd.Series) -> pd.Series:
        def split(sections):
            if sections is None:
                return None
            rows = []
            for number, section in enumerate(sections):
                for low, high in spans(section, limit, overlap):
                    piece = section[low:high]
                    rows.append({"section": number, "start": low, "end": high, "text": piece.strip(WHITESPACE) if trim else piece})
            return rows

        return texts.map(split)

    return split_long


def _with_pieces(docs: DataFrame, limit: int, split_long) -> DataFrame:
    """Add ``__pieces``: the chunks of every section in order; Python sees only documents with an overlong section."""
    too_long = F.exists("__sections", lambda s: F.length(s["text"]) > limit)
    split = docs.withColumn("__split", split_long(F.when(too_long, F.transform("__sections", lambda s: s["text"]))))
    whole = F.transform(
        "__sections",
        lambda s, i: F.struct(
            i.alias("section"),
            F.lit(0).cast("bigint").alias("start"),
            F.length(s["text"]).cast("bigint").alias("end"),
            s["text"].alias("text"),
        ),
    )
    return split.withColumn("__pieces", F.coalesce(F.col("__split"), whole)).drop("__split")


def _numbered(pieces: DataFrame, keys: tuple[str, ...], extra: str, total: Column) -> DataFrame:
    """Explode ``__pieces``; the position in the array is the chunk number and its size the total."""
    exploded = explode_positions(pieces, "__pieces", *keys, extra, F.size("__pieces").alias("__n"))
    return exploded.select(
        *keys,
        F.format_string("chunk_%03d", F.col("pos") + 1).alias("chunk_id"),
        (F.col("pos") + 1).cast("bigint").alias("chunk_index"),
        total.cast("bigint").alias("chunk_total"),
        extra,
        F.col("item").alias("__piece"),
    )


def chunk_sizes(max_chars: int, overlap_chars: int) -> tuple[int, int]:
    limit = max(MIN_MAX_CHARS, max_chars)
    return limit, max(0, min(overlap_chars, int(limit * MAX_OVERLAP_SHARE)))


def sections_of(docs: DataFrame, *keys: str) -> DataFrame:
    """One row per section with its extent."""
    exploded = explode_positions(_with_sections(docs), "__sections", *keys).withColumnRenamed("item", "s")
    return exploded.select(
        *keys,
        (F.col("pos") + 1).cast("bigint").alias("section_index"),
        F.col("s.heading").alias("heading"),
        F.col("s.start").alias("start_offset"),
        F.col("s.end").alias("end_offset"),
        F.col("s.text").alias("text"),
    )


def chunk_documents(
    docs: DataFrame, *keys: str, max_chars: int = MAX_CHARS, overlap_chars: int = OVERLAP_CHARS
) -> DataFrame:
    """Structure-aware chunks of ``text``; a chunk's text is exactly the source slice its offsets name."""
    limit, overlap = chunk_sizes(max_chars, overlap_chars)
    pieces = _with_pieces(_with_sections(docs), limit, _splitter(_structured_spans, limit, overlap, trim=False))
    titles = F.transform("__sections", lambda s: F.struct(s["heading"].alias("heading"), s["start"].alias("start")))
    numbered = _numbered(pieces.withColumn("__titles", titles), keys, "__titles", F.col("__n"))
    section = F.get("__titles", F.col("__piece.section"))
    return numbered.select(
        *keys,
        "chunk_id",
        "chunk_index",
        "chunk_total",
        section["heading"].alias("heading"),
        (section["start"] + F.col("__piece.start")).alias("start_offset"),
        (section["start"] + F.col("__piece.end")).alias("end_offset"),
        F.col("__piece.text").alias("text"),
    )


def chunk_documents_by_paragraph(
    docs: DataFrame,
    *keys: str,
    max_chars: int = SHORT_MAX_CHARS,
    overlap_chars: int = SHORT_OVERLAP_CHARS,
    set_total: bool = True,
) -> DataFrame:
    """The older chunker: three heading levels, text before the first heading dropped, trimmed pieces.

    Offsets are those of the first occurrence of a piece's first 50 characters (0 when absent).
    """
    sectioned = _with_short_sections(docs)
    pieces = _with_pieces(sectioned, max_chars, _splitter(_short_spans, max_chars, overlap_chars, trim=True))
    located = F.transform(
        "__pieces",
        lambda p: F.struct(
            F.get(F.col("__headings"), p["section"]).alias("heading"),
            F.greatest(F.position(js_trim(F.substring(p["text"], 1, LOCATE_CHARS)), F.col("text")) - 1, F.lit(0))
            .cast("bigint")
            .alias("start"),
            p["text"].alias("text"),
        ),
    )
    titles = F.transform("__sections", lambda s: s["heading"])
    placed = pieces.withColumn("__headings", titles).withColumn("__pieces", located).withColumn("__none", F.lit(0))
    numbered = _numbered(placed, keys, "__none", F.col("__n") if set_total else F.lit(0))
    return numbered.select(
        *keys,
        "chunk_id",
        "chunk_index",
        "chunk_total",
        F.col("__piece.heading").alias("heading"),
        F.col("__piece.start").alias("start_offset"),
        (F.col("__piece.start") + F.length("__piece.text")).alias("end_offset"),
        F.col("__piece.text").alias("text"),
    )
