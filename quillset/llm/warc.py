"""WARC archives: one transaction (request, response or revisit, metadata) per page, and its assembly by concurrent-to identifiers into
one nested row per capture.

Defined results: a null payload is empty, a null url gives records without target; of equal payloads of at least ``revisit_bytes`` bytes
that with the largest page_id is the response (of rows that repeat that id as well, one; null ids are smallest), the others are
revisits of it; every input row is a transaction of its own, repeated rows too; a transaction without request or
metadata keeps nulls there; no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillset.llm.shared import Scratch, own_columns

# Words of the format.
VERSION, END, PROFILE = "WARC/1.1", "\r\n", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "kind string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, payload_digest string, payload_bytes bigint, first_line string, fields map<string,string>, file string, offset bigint, payload binary"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: twenty bits at a time, digits of base 32 written in the other alphabet."""
    hexed = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws("\n", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *cut))


def _lines(*pairs: tuple[str, Column]) -> Column:
    """Header lines; a null value leaves its line out."""
    return F.concat_ws("", *[F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(END)) for name, value in pairs])


def _record(kind: str | Column, headers: Column, block: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    size = F.octet_length(block.cast("binary"))
    return F.concat(F.lit(f"{VERSION}{END}WARC-Type: "), kind, F.lit(END), headers, _lines(("Content-Length", size)), F.lit(END), block)


def write_archives(pages: DataFrame, path: str, revisit_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", captures_per_file: int = 500, salts: int = 16) -> None:
    """Write the transactions of (page_id, url, html) as gzip-compressed archives of at most ``captures_per_file`` captures.

    Spark's own text writer does it: a record is text, two line ends separate records, and its commit protocol leaves no half
    files behind when an executor is lost. Payload groups are reduced to (digest, largest id) by a partial aggregate before they
    are joined back; that small side is repeated for ``salts`` salts, so a payload that a third of all pages share is joined in
    many tasks.
    """
    rows = own_columns(pages, page_id="page_id", url="url", html="html").select(
        F.monotonically_increasing_id().alias("rid"), F.col("page_id").cast("bigint").alias("page_id"), F.regexp_replace("url", "[\\x00-\\x20]", "%20").alias("url"), F.coalesce("html", F.lit("")).alias("html")
    )
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length(F.col("html").cast("binary")))
    first = rows.filter(F.col("bytes") >= revisit_bytes).groupBy("digest").agg(F.max(F.struct("page_id", "rid")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    salted = first.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    joined = rows.withColumn("salt", F.pmod("rid", F.lit(salts)).cast("int")).join(salted, ["digest", "salt"], "left")
    other = F.col("first").isNotNull() & (F.col("first.rid") != F.col("rid"))
    own, target = _urn("response", F.col("rid"), F.col("page_id")), F.when(other, _urn("response", F.col("first.rid"), F.col("first.page_id")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    host, rest = F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-zA-Z]+://([^/]*)", 1), F.regexp_replace(F.coalesce("url", F.lit("")), "^[a-zA-Z]+://[^/]*", "")
    shared = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))]
    wrap = lambda urn: F.concat(F.lit("<"), urn, F.lit(">"))
    response = _record(
        F.when(other, "revisit").otherwise("response"),
        _lines(
            ("WARC-Record-ID", wrap(own)), *shared, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("html").cast("binary")))),
            ("WARC-Refers-To", wrap(target)), ("WARC-Profile", F.when(other, PROFILE)), ("Content-Type", F.lit("application/http; msgtype=response")),
        ),
        F.when(other, http).otherwise(F.concat(http, F.col("html"))),
    )
    beside = ("WARC-Concurrent-To", wrap(own))
    request = _record(
        "request",
        _lines(("WARC-Record-ID", wrap(_urn("request", F.col("rid"), F.col("page_id")))), *shared, beside, ("Content-Type", F.lit("application/http; msgtype=request"))),
        F.concat(F.lit("GET "), F.when(rest == "", "/").otherwise(rest), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")),
    )
    metadata = _record(
        "metadata",
        _lines(("WARC-Record-ID", wrap(_urn("metadata", F.col("rid"), F.col("page_id")))), *shared, beside, ("Content-Type", F.lit("application/warc-fields"))),
        _lines(("page-id", F.col("page_id")), ("charset", F.lit("utf-8"))),
    )
    written = joined.select(F.explode(F.array(request, response, metadata)).alias("value"))
    written.write.option("lineSep", END * 2).option("compression", "gzip").option("maxRecordsPerFile", 3 * captures_per_file).text(path)


def _records(raw: bytes, keep_payload: bool) -> Iterator[dict]:
    """Records of one archive, plain or of any number of gzip members, by their declared lengths."""
    source = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw))
    offset = 0

    def line() -> bytes:
        nonlocal offset
        got = source.readline()
        offset += len(got)
        return got

    while got := line():
        if not got.strip():
            continue
        start = offset - len(got)
        if not got.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {start}")
        head = {}
        while (got := line()).strip():
            name, _, value = got.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        block = source.read(size)
        if len(block) != size:
            raise ValueError(f"record at byte {start} ends early")
        offset += size
        bare = lambda name: head.get(name, "").strip("<>") or None
        row = {"kind": head.get("warc-type"), "record_id": bare("warc-record-id"), "concurrent_to": bare("warc-concurrent-to"), "refers_to": bare("warc-refers-to"), "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "offset": start}
        if head.get("content-type", "").startswith("application/http"):
            top, _, payload = block.partition(b"\r\n\r\n")
            lines = top.decode("utf-8", "replace").split(END)
            fields, row["first_line"] = lines[1:], lines[0]
            if row["kind"] == "response":
                row |= {"payload_bytes": len(payload), "payload_digest": b32encode(hashlib.sha1(payload).digest()).decode(), "payload": payload if keep_payload else None}
            elif row["kind"] == "revisit":
                row["payload_digest"] = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        else:
            fields = block.decode("utf-8", "replace").split(END)
        row["fields"] = [(n.strip().lower(), v.strip()) for n, s, v in (f.partition(":") for f in fields) if s]
        row["fields"] = list(dict(row["fields"]).items())
        yield row


def read_records(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """One row per record of the archives under ``path``; files are dealt to tasks by Spark, whole, and parsed record by record."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, fields = pa.string(), pa.map_(pa.string(), pa.string())
        kinds = {"payload_bytes": pa.int64(), "offset": pa.int64(), "payload": pa.binary(), "fields": fields}
        names = [c.split()[0] for c in RECORD.replace("map<string,string>", "map").split(", ")]
        out = pa.schema([(n, kinds.get(n, text)) for n in names])
        for batch in batches:
            for file, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for row in _records(raw.as_py(), keep_payload):
                    rows.append({n: row.get(n) for n in names} | {"file": file})
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, out)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, out)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: refers_to_id, capture STRUCT<response, request, metadata>.

    Requests and metadata name the response or revisit they belong to in their concurrent-to field; these ids are unique, so the joins
    have no hot key. A revisit takes the payload's size from the response it refers to; many revisits may refer to one response, and
    that join carries only ids and lengths, so Spark splits it where it is skewed.
    """
    parts = lambda kind: records.filter(F.col("kind") == kind)
    described = ["record_id", "target_uri", "date", "file", "offset"]
    request = parts("request").select(F.col("concurrent_to").alias("id"), F.struct(*described, F.split("first_line", " ")[0].alias("method"), "fields").alias("request"))
    metadata = parts("metadata").select(F.col("concurrent_to").alias("id"), F.struct(*described, F.col("fields")["charset"].alias("charset"), F.col("fields")["page-id"].cast("bigint").alias("page_id")).alias("metadata"))
    main = records.filter(F.col("kind").isin("response", "revisit"))
    lengths = main.filter(F.col("kind") == "response").select(F.col("record_id").alias("refers_to"), F.col("payload_bytes").alias("of_response"))
    main = main.join(lengths, "refers_to", "left").select(
        F.col("record_id").alias("id"), "refers_to",
        F.struct(*described, F.col("kind").alias("record_type"), F.coalesce("payload_bytes", "of_response").alias("payload_bytes"), "payload_digest", "first_line", "fields", "payload").alias("response"),
    )
    whole = main.join(request, "id", "left").join(metadata, "id", "left")
    return whole.select("id", F.col("refers_to").alias("refers_to_id"), F.struct("response", "request", "metadata").alias("capture"))


def archived_captures(pages: DataFrame, keep_payload: bool = False, **options) -> DataFrame:
    """Write archives of ``pages`` to the shared folder, read them back and assemble: page_id, refers_to (page_id), capture."""
    scratch = Scratch(pages.sparkSession, "warc")
    write_archives(pages, scratch.path("archives"), **options)
    records = scratch.store(read_records(pages.sparkSession, scratch.path("archives"), keep_payload), "records")
    captures = scratch.store(assemble(records), "captures")
    scratch.forget("records")
    pages_of = captures.filter(F.col("capture.response.record_type") == "response").select(F.col("id").alias("refers_to_id"), F.col("capture.metadata.page_id").alias("refers_to"))
    return captures.join(pages_of, "refers_to_id", "left").select(F.col("capture.metadata.page_id").alias("page_id"), "refers_to", "capture")
