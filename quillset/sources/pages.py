"""Web pages and page tables as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillset.functions.html import clean_text, strip_html
from quillset.functions.text import computed_once, js_trim

# Fixed value: a paged document whose trimmed text is shorter than this is probably a scan.
SCANNED_BELOW_CHARS = 20


def pages_to_documents(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Strip the HTML of each page and clean the result; headings survive as ``#`` lines."""
    return computed_once(pages.select(key, html), "text", clean_text(strip_html(F.col(html)))).select(key, "text")


def assemble_pages(pages: DataFrame, document: str, page_no: str = "page_no", text: str = "text") -> DataFrame:
    """Join the pages of each document in order under page headers and flag probable scans.

    One output row is one document, whose size the upload limit bounds.
    """
    header = F.concat(F.lit("=== 第 "), F.col(page_no).cast("string"), F.lit(" 页 ===\n"), F.coalesce(F.col(text), F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page_no).alias("no"), header.alias("body"))))
    docs = pages.groupBy(document).agg(ordered.alias("parts"))
    return docs.select(
        document,
        F.size("parts").cast("bigint").alias("page_count"),
        F.array_join(F.transform("parts", lambda part: part["body"]), "\n\n").alias("text"),
    ).withColumn("maybe_scanned", F.length(js_trim(F.col("text"))) < SCANNED_BELOW_CHARS)
