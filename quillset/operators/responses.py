"""From raw model responses to validated items."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from quillset.functions.text import WS, explode_positions, is_blank, js_trim

# Where an item array may sit, the patterns of the repair steps, and the messages reported.
ARRAY_KEYS = ("items", "data", "alpaca_data", "alpacaData", "dataset", "records")
FENCED_BLOCK = "(?s)```(?:json)?\\s*(.*?)```"
OUTER_BRACES = "(?s)\\{.*\\}"
REPAIRS = (
    ("'", '"'),
    (f",{WS}*\\}}", "}"),
    (f",{WS}*\\]", "]"),
    (f"([{{,]{WS}*)(\\w+)({WS}*:)", '$1"$2"$3'),
)
EMPTY_RESPONSE = "LLM 返回了空内容，无法解析。"
BAD_BLOCK = "从代码块中提取到的内容不是有效 JSON。"
REPAIRED = "已自动修复 LLM 输出的格式问题。"
UNPARSABLE = "无法解析 LLM 输出：不是有效的 JSON 格式。"
NO_ARRAY = "JSON 中未找到数据集数组（期望字段名：items / data / alpaca_data）。"
BAD_ITEM = ("第 ", " 条数据缺少必要字段，已跳过。")


def strict_json(text: Column) -> Column:
    """Standard JSON re-serialised (duplicate keys resolved); null when invalid or when the root is null, 0, "" or false.

    Neither ``from_json`` (single quotes, NaN) nor ``try_parse_json`` (trailing text, duplicate keys) is that strict.
    """
    return _strict_json_udf()(text)


def _strict_json_udf():
    # Made per use: once called, a function of the JVM hangs on it, and a generator that refers to this library could not be sent to tasks.
    def reject(name):
        raise ValueError(name)

    def check(text):
        if text is None:
            return None
        try:
            root = json.loads(text, parse_constant=reject)
            falsy = root is None or root is False or (isinstance(root, (int, float)) and root == 0) or root == ""
            return None if falsy else json.dumps(root, allow_nan=False)
        except (ValueError, RecursionError):
            return None

    @pandas_udf(StringType())
    def parsed(texts: pd.Series) -> pd.Series:
        return texts.map(check)

    return parsed


def fenced_block(text: Column) -> Column:
    """Trimmed content of the first fenced block; null when there is none or it is blank."""
    block = js_trim(F.regexp_extract(text, FENCED_BLOCK, 1))
    return F.when(block != "", block)


def repaired_json(text: Column) -> Column:
    trimmed = js_trim(text)
    inner = F.regexp_extract(trimmed, OUTER_BRACES, 0)
    fixed = F.when(inner != "", inner).otherwise(trimmed)
    for pattern, replacement in REPAIRS:
        fixed = F.regexp_replace(fixed, pattern, replacement)
    return fixed


def _is_string(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def _text(value: Column) -> Column:
    return F.when(_is_string(value), F.try_variant_get(value, "$", "string"))


def _field(item: Column, name: str) -> Column:
    return F.try_variant_get(item, f"$.{name}", "variant")


def with_parsed(responses: DataFrame, content: str = "raw_content") -> DataFrame:
    """Add ``strategy``, ``__items`` (array of variants) and ``__errors`` (messages not tied to one item)."""
    raw = F.col(content)
    staged = responses.withColumn("__empty", is_blank(raw))
    staged = staged.withColumn("__direct", strict_json(F.when(~F.col("__empty"), raw)))
    undecided = ~F.col("__empty") & F.col("__direct").isNull()
    staged = staged.withColumn("__block", F.when(undecided, fenced_block(raw)))
    staged = staged.withColumn("__fenced", strict_json(F.col("__block")))
    staged = staged.withColumn("__mended", strict_json(F.when(undecided & F.col("__block").isNull(), repaired_json(raw))))
    strategy = (
        F.when(F.col("__empty"), "empty")
        .when(F.col("__direct").isNotNull(), "direct")
        .when(F.col("__fenced").isNotNull(), "fenced")
        .when(F.col("__mended").isNotNull(), "repaired")
        .otherwise("none")
    )
    root = F.try_parse_json(F.coalesce("__direct", "__fenced", "__mended"))
    staged = staged.withColumns({"strategy": strategy, "__root": root})
    # Expressions on a variant re-read it, so the root is a column of its own before it is looked into.
    kind = F.schema_of_variant("__root")
    staged = staged.withColumns({"__is_array": kind.startswith("ARRAY"), "__is_object": kind.startswith("OBJECT")})
    arrays = [F.try_variant_get("__root", f"$.{key}", "array<variant>") for key in ARRAY_KEYS]
    single = F.when(_is_string(_field(F.col("__root"), "instruction")), F.array("__root"))
    located = F.when(F.col("__is_array"), F.try_variant_get("__root", "$", "array<variant>")).when(
        F.col("__is_object"), F.coalesce(*arrays, single)
    )
    staged = staged.withColumn("__items", located)
    errors = F.array_compact(
        F.array(
            F.when(F.col("__empty"), EMPTY_RESPONSE),
            F.when(F.col("__is_object") & F.col("__items").isNull(), NO_ARRAY),
            F.when(F.col("strategy") == "repaired", REPAIRED),
            F.when((F.col("strategy") == "none") & F.col("__block").isNotNull(), BAD_BLOCK),
            F.when((F.col("strategy") == "none") & F.col("__block").isNull(), UNPARSABLE),
        )
    )
    return staged.withColumn("__errors", errors).drop(
        "__empty", "__direct", "__block", "__fenced", "__mended", "__root", "__is_array", "__is_object"
    )


def _checked(item: Column) -> Column:
    """Struct of the item's three texts and whether it is valid: text question and answer, input absent or text."""
    question, answer, extra = (_field(item, name) for name in ("instruction", "output", "input"))
    return F.struct(
        _text(question).alias("instruction"),
        F.coalesce(_text(extra), F.lit("")).alias("input"),
        _text(answer).alias("output"),
        (
            _is_string(question)
            & ~is_blank(_text(question))
            & _is_string(answer)
            & ~is_blank(_text(answer))
            & (extra.isNull() | _is_string(extra))
        ).alias("valid"),
    )


def parse_items(responses: DataFrame, *keys: str, content: str = "raw_content") -> DataFrame:
    """One row per item found, valid or not, with its 1-based position in the response."""
    parsed = with_parsed(responses, content)
    exploded = explode_positions(parsed, "__items", *keys, "strategy")
    return exploded.withColumn("item", _checked(F.col("item"))).select(
        *keys, "strategy", (F.col("pos") + 1).cast("bigint").alias("item_no"), "item.*"
    )


def valid_items(items: DataFrame) -> DataFrame:
    return items.filter("valid").drop("valid")


def parse_summary(responses: DataFrame, *keys: str, content: str = "raw_content") -> DataFrame:
    """Per response: strategy, items found, items valid and the error messages. Row-local, nothing is shuffled."""
    parsed = with_parsed(responses, content)
    validity = F.transform(F.coalesce("__items", F.array().cast("array<variant>")), lambda item: _checked(item)["valid"])
    staged = parsed.withColumn("__valid", validity)
    skipped = F.filter(
        F.transform("__valid", lambda ok, i: F.when(~ok, F.concat(F.lit(BAD_ITEM[0]), (i + 1).cast("string"), F.lit(BAD_ITEM[1])))),
        lambda message: message.isNotNull(),
    )
    return staged.select(
        *keys,
        "strategy",
        F.size("__valid").cast("bigint").alias("total_count"),
        F.size(F.filter("__valid", lambda ok: ok)).cast("bigint").alias("valid_count"),
        F.concat("__errors", skipped).alias("parse_errors"),
    )
