"""HTML to text and text clean-up as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillset.functions.text import js_trim

# What is removed, what becomes a line break, and which named entities are known.
SCRIPT_BLOCK = "(?is)<script[^>]*>.*?</script>"
STYLE_BLOCK = "(?is)<style[^>]*>.*?</style>"
BREAKING_TAG = "(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr|/td|/th)[^>]*>"
ANY_TAG = "<[^>]+>"
NAMED_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
NUMERIC_ENTITY = "&#([0-9]+);"


def decode_numeric_entities(text: Column) -> Column:
    """Replace ``&#n;`` by the UTF-16 unit ``n``: the pieces between entities are zipped with decoded characters."""
    codes = F.regexp_extract_all(text, F.lit(NUMERIC_ENTITY), F.lit(1))
    decoded = F.transform(
        codes,
        lambda code: F.decode(
            F.unhex(F.lpad(F.hex(code.cast("decimal(38,0)").cast("bigint") % F.lit(65536)), 4, "0")), "UTF-16BE"
        ),
    )
    pieces = F.split(text, NUMERIC_ENTITY, -1)
    rebuilt = F.array_join(
        F.zip_with(pieces, decoded, lambda piece, ch: F.concat(piece, F.coalesce(ch, F.lit("")))), ""
    )
    return F.when(text.contains("&#"), rebuilt).otherwise(text)


def strip_html(html: Column) -> Column:
    text = F.regexp_replace(html, SCRIPT_BLOCK, "")
    for level in range(1, 7):
        text = F.regexp_replace(text, f"(?i)<h{level}[^>]*>", "#" * level + " ")
    text = F.regexp_replace(text, BREAKING_TAG, "\n")
    text = F.regexp_replace(text, STYLE_BLOCK, "")
    text = F.regexp_replace(text, ANY_TAG, " ")
    for entity, char in NAMED_ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = decode_numeric_entities(text)
    text = F.regexp_replace(text, "[ \\t]+", " ")
    return js_trim(F.regexp_replace(text, "\\n{3,}", "\n\n"))


def clean_text(text: Column) -> Column:
    """Trim every line, keep at most one blank line in a row, trim the whole."""
    lines = F.transform(F.split(text, "\n", -1), js_trim)
    return js_trim(F.regexp_replace(F.array_join(lines, "\n"), "\\n{3,}", "\n\n"))


def paragraph_count(text: Column) -> Column:
    from quillset.functions.text import WS

    blocks = F.split(text, f"\\n{WS}*\\n", -1)
    return F.size(F.filter(blocks, lambda block: F.length(js_trim(block)) > 0)).cast("bigint")
