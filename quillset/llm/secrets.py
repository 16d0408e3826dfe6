"""Secrets in texts: fixed patterns, and a token-efficiency test that exposes random strings by their few characters per token.

A byte-pair vocabulary spells words with long tokens and random characters with short ones. Candidates of at least ``MIN_CHARS`` characters
from the alphabets of keys are encoded; below ``RATIO`` characters per token they are reported as ``random``, unless they are known digests
(hexadecimal of a usual digest length), UUIDs or lie inside a span that a pattern has found. Candidates that pass as a whole are tested between
their ``/``, ``-`` and ``_`` too, so words around a key do not hide it.

Defined results: a null text is empty (no spans); offsets count code points, ends are exclusive; spans of one kind never overlap; a null
``doc_id`` stays null; repeated rows give repeated rows; no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillset.llm.shared import outside, own_columns

# The patterns asked for and the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")

MIN_CHARS, RATIO = 20, 2.1
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_CHARS)
DIGEST_CHARS = (32, 40, 48, 56, 64, 96, 128)
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
STRETCH = re.compile(r"%s(?![^/_-])|[^/_-]+" % UUID.pattern)
HEX_ONLY = re.compile(r"[0-9A-F]+|[0-9a-f]+")


def known_identifier(value: str) -> bool:
    return bool(UUID.fullmatch(value)) or len(value) in DIGEST_CHARS and bool(HEX_ONLY.fullmatch(value))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    found, low = [], text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def random_spans(text: str, base: list[tuple[int, int, int]], encode) -> list[tuple[int, int, int]]:
    """Candidates that fail the ratio as a whole; of the others, what fails between their separators."""
    fails = lambda value: not known_identifier(value) and len(value) < RATIO * len(encode(value))
    found = []
    for m in CANDIDATE.finditer(text):
        spans = [m.span()] if fails(m[0]) else [] if known_identifier(m[0]) else _random_parts(m[0], m.start(), fails)
        found += spans
    return [(start, 3, end) for start, end in outside(found, [(s, e) for s, _, e in base])]


def _random_parts(value: str, at: int, fails) -> list[tuple[int, int]]:
    """Spans inside a candidate: runs of stretches that all fail, separators between them included (keys may hold those too), if the run
    fails as well, else the stretches of such a run that are long enough alone."""
    runs: list[list[tuple[int, int]]] = [[]]
    for m in STRETCH.finditer(value):
        if fails(m[0]):
            runs[-1].append(m.span())
        elif runs[-1]:
            runs.append([])
    out = []
    for run in filter(None, runs):
        whole = (run[0][0], run[-1][1])
        long = [whole] if fails(value[slice(*whole)]) else run
        out += [(at + start, at + end) for start, end in long if end - start >= MIN_CHARS]
    return out


def _encoder(vocabulary: str | None):
    import public_tokenizers
    import tiktoken

    with open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def scan(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, spans ARRAY<STRUCT<kind, start, end>>, redacted: one row per input row, whole texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary)
        span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            spans = []
            for value in batch.column("text"):
                text = value.as_py() or ""
                base = base_spans(text)
                every = sorted(base + random_spans(text, base, encode))
                spans.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in every])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in batch.schema.names], pa.array(spans, pa.list_(span))], names=[*batch.schema.names, "spans"])

    rows = own_columns(docs, doc_id="doc_id", text="text").selectExpr("cast(doc_id as bigint) doc_id", "text")
    return rows.mapInArrow(work, "doc_id bigint, text string, spans array<struct<kind:string,start:int,end:int>>")


def scan_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (joined), n_random."""
    found = scan(docs, vocabulary).select("doc_id", "spans")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != KINDS[3])).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count(KINDS[3]).alias("n_random"),
    )


def redacted(text: str, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str:
    """``text`` with every stretch covered by a span replaced by ``mark`` once; ``mark`` itself holds no secret."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The same rows and columns, secrets in ``text`` replaced, ``n_chars`` (if there is one) counted again; rows without one unchanged."""
    others = [c for c in docs.columns if c != "text"]
    schema = docs.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary)
        for batch in batches:
            texts = []
            for value in batch.column("text"):
                text = value.as_py()
                if text:
                    base = base_spans(text)
                    spans = [(s, e) for s, _, e in base + random_spans(text, base, encode)]
                    text = redacted(text, spans) if spans else text
                texts.append(text)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array(texts, pa.string())], names=[*others, "text"])

    out = docs.select(*others, "text").mapInArrow(work, docs.select(*others, "text").schema)
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType))
    return out.select(*docs.columns)
