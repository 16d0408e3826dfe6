"""Binding an answer to the part of its chunk that supports it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from quillset.functions.text import computed_once, js_trim

# Window size and stride, probe lengths, acceptance share and lead before the anchor.
WINDOW_CHARS, WINDOW_STEP, MIN_PROBE_CHARS, PROBE_CHARS = 800, 240, 6, 80
MIN_WINDOW_SHARE, LEAD_CHARS = 0.12, 280
SENTENCE_END = "[。！？.!?\\n]"


def _letters(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points that survive normalisation and the position each comes from."""
    low = text.lower()
    at = np.arange(len(text))
    if len(low) != len(text):
        # A few characters grow when lower-cased.
        at = np.repeat(at, [len(c.lower()) for c in text])
        low = "".join(c.lower() for c in text)
    code = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    keep = ((code >= 97) & (code <= 122)) | ((code >= 48) & (code <= 57)) | ((code >= 0x3400) & (code <= 0x9FFF))
    return code[keep], at[keep]


def _best_window(text: str, answer: str) -> tuple[float, int]:
    """Largest share of the answer's bigrams found in one window, and where the earliest such window starts."""
    wanted, _ = _letters(answer)
    code, at = _letters(text)
    starts = np.arange(0, len(text), WINDOW_STEP)
    if len(wanted) == 1:
        first, last = np.searchsorted(at, starts), np.searchsorted(at, starts + WINDOW_CHARS)
        hits = [int(b - a == 1 and code[a] == wanted[0]) for a, b in zip(first, last)]
    elif len(wanted) == 0 or len(code) < 2:
        return 0.0, 0
    else:
        units = np.unique(wanted[:-1] << 32 | wanted[1:])
        pairs = code[:-1] << 32 | code[1:]
        slot = np.minimum(np.searchsorted(units, pairs), len(units) - 1)
        found = np.flatnonzero(units[slot] == pairs)
        slot = slot[found]
        first = np.searchsorted(at[found], starts)
        last = np.searchsorted(at[found + 1], starts + WINDOW_CHARS)
        hits = [len(np.unique(slot[a:b])) / len(units) for a, b in zip(first, last)]
    best = int(np.argmax(hits))
    return float(hits[best]), int(starts[best])


def _window_udf():
    @pandas_udf(StructType([StructField("share", DoubleType()), StructField("at", LongType())]))
    def best_window(texts: pd.Series, answers: pd.Series) -> pd.DataFrame:
        found = [(None, None) if t is None or a is None else _best_window(t, a) for t, a in zip(texts, answers)]
        return pd.DataFrame(found, columns=["share", "at"]).astype({"share": "float64", "at": "Int64"})

    return best_window


def with_evidence(df: DataFrame, chunk: str = "chunk_text", answer: str = "output") -> DataFrame:
    """Add ``evidence``: struct(text, start, end, available), offsets local to the chunk.

    A short chunk is its own evidence. Otherwise the longest answer sentence found verbatim anchors the window, else
    the window sharing most answer bigrams (the earliest of equals), else the evidence is unavailable.
    """
    text, size = F.col(chunk), F.length(F.col(chunk))
    probes = F.filter(
        F.transform(F.split(F.col(answer), SENTENCE_END, -1), js_trim), lambda s: F.length(s) >= MIN_PROBE_CHARS
    )
    # Longest first, ties in answer order: a sort key of (-length, position).
    ranked = F.array_sort(
        F.transform(probes, lambda s, i: F.struct((-F.length(s)).alias("k"), i.alias("i"), F.substring(s, 1, PROBE_CHARS).alias("p")))
    )
    hits = F.filter(F.transform(ranked, lambda r: F.position(r["p"], text)), lambda at: at > 0)
    staged = df.withColumn("__anchor", F.when(size > WINDOW_CHARS, F.try_element_at(hits, F.lit(1)) - 1))
    # Only rows without a verbatim hit send their texts to Python: scoring overlapping windows is array arithmetic.
    missing = (size > WINDOW_CHARS) & F.col("__anchor").isNull()
    staged = staged.withColumn("__best", _window_udf()(F.when(missing, text), F.when(missing, F.col(answer))))
    anchor = F.coalesce(
        F.col("__anchor"),
        F.when(F.col("__best.share") >= MIN_WINDOW_SHARE, F.col("__best.at") + WINDOW_CHARS // 2),
    )
    # greatest and least skip nulls, so a missing anchor is kept apart.
    start = F.when(anchor.isNotNull(), F.greatest(F.lit(0), F.least(size - WINDOW_CHARS, anchor - LEAD_CHARS)))
    staged = staged.withColumn("__start", F.when(size > WINDOW_CHARS, start).otherwise(F.lit(0)))
    found = F.col("__start").isNotNull()
    end = F.when(found & (size > WINDOW_CHARS), F.least(size, F.col("__start") + WINDOW_CHARS)).otherwise(size)
    cut = F.concat(
        F.when(F.col("__start") > 0, F.lit("…")).otherwise(F.lit("")),
        F.substring(text, (F.col("__start") + 1).cast("int"), F.lit(WINDOW_CHARS)),
        F.when(F.col("__start") + WINDOW_CHARS < size, F.lit("…")).otherwise(F.lit("")),
    )
    evidence = F.struct(
        F.when(size <= WINDOW_CHARS, text).when(found, cut).otherwise(F.lit("")).alias("text"),
        F.coalesce(F.col("__start"), F.lit(0)).cast("bigint").alias("start"),
        end.cast("bigint").alias("end"),
        found.alias("available"),
    )
    return computed_once(staged, "evidence", evidence).drop("__anchor", "__best", "__start")


def bind_to_chunks(items: DataFrame, chunks: DataFrame, *keys: str) -> DataFrame:
    """Join generated items to the chunk they came from on ``keys`` and localise their evidence.

    ``source`` carries absolute offsets: the chunk's start plus the local ones.
    """
    bound = items.join(chunks.withColumnRenamed("text", "chunk_text"), list(keys))
    located = with_evidence(bound)
    source = F.struct(
        "document_id",
        F.col("source_name").alias("file_name"),
        "file_type",
        "chunk_id",
        "heading",
        (F.col("start_offset") + F.col("evidence.start")).alias("start_offset"),
        (F.col("start_offset") + F.col("evidence.end")).alias("end_offset"),
        F.col("evidence.text").alias("text"),
        F.col("evidence.available").alias("available"),
    )
    return located.withColumn("source", source).drop("chunk_text", "evidence", "start_offset", "end_offset", "heading")


def with_no_evidence(items: DataFrame, document_id: Column, file_name: Column, file_type: Column, chunk_id: Column) -> DataFrame:
    """Give items an empty, unavailable ``source``."""
    source = F.struct(
        document_id.alias("document_id"),
        file_name.alias("file_name"),
        file_type.alias("file_type"),
        chunk_id.alias("chunk_id"),
        F.lit(None).cast("string").alias("heading"),
        F.lit(0).cast("bigint").alias("start_offset"),
        F.lit(0).cast("bigint").alias("end_offset"),
        F.lit("").alias("text"),
        F.lit(False).alias("available"),
    )
    return items.withColumn("source", source)
