"""Text primitives as Column expressions.

Everything is built from native functions so it stays inside the JVM. Whitespace follows the ECMAScript
definition (``trim`` and ``\\s`` include NBSP, the ideographic space and the BOM), which neither Spark's ``trim``
nor Java's ``\\s`` covers. Lengths and offsets count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ECMAScript white space and line terminators.
WHITESPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WS = "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
# Java's multiline anchors, minus NEL, which ECMAScript does not count as a line terminator.
LINE_START = "(?m:^(?<!\\u0085))"
LINE_END = "(?m:$(?!\\u0085))"
NOT_LINE_END = "[^\\n\\r\\u2028\\u2029]"

# The characters each normaliser keeps, and the synonym and filler word lists.
KEEP_FOR_QUALITY = "[^a-z0-9\\u3400-\\u9fff._+\\-]+"
KEEP_FOR_DEDUP = "[^a-z0-9\\u3400-\\u9fff]+"
KEEP_FOR_TRIGRAMS = "[^A-Za-z0-9_\\u4e00-\\u9fff]+"
LATIN_TOKEN = "[a-z0-9][a-z0-9._+\\-]*"
HAN_RUN = "[\\u3400-\\u9fff]+"
SETTING_WORDS, SETTING_WORD = "设置|设定|调整", "配置"
DEDUP_HOW_WORDS, SEARCH_HOW_WORDS, HOW_WORD = "怎样|怎么", "怎样|怎么|如何进行", "如何"
SEARCH_METHOD_WORDS, METHOD_WORD = "步骤|流程|办法", "方法"
DEDUP_FILLER_WORDS = "请问|如何|方法|步骤|流程|需要|应该|要|的|是"
FNV_BASIS, FNV_PRIME, MASK_32 = 2166136261, 16777619, 4294967295


def js_trim(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return F.coalesce(F.length(js_trim(text)), F.lit(0)) == 0


def grams(text: Column, n: int) -> Column:
    """Distinct character n-grams; a lookahead keeps this linear (``substr`` would rescan from the start)."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * n}))"), F.lit(1)))


def chars(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)))


def codes(units: Column) -> Column:
    """Strings of up to three characters below U+FFFF as integers, 16 bits per character.

    Exact, and integer arrays are several times smaller to shuffle and faster to intersect than string arrays.
    """
    point = lambda unit, i: F.ascii(F.substring(unit, i, 1)).cast("bigint")
    return F.transform(
        units, lambda unit: F.shiftleft(point(unit, 1), 32) + F.shiftleft(point(unit, 2), 16) + point(unit, 3)
    )


def distinct_matches(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


# --- quality scoring -------------------------------------------------------------------------------------------


def quality_norm(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), KEEP_FOR_QUALITY, " "))


def text_units(text: Column) -> Column:
    """Latin tokens together with bigrams over the Han text that is left once they are removed."""
    norm = quality_norm(text)
    han = F.regexp_replace(norm, "[a-z0-9._+\\- ]+", "")
    han_units = F.when(F.length(han) == 1, F.array(han)).otherwise(grams(han, 2))
    return F.array_distinct(F.concat(F.regexp_extract_all(norm, F.lit(LATIN_TOKEN), F.lit(0)), han_units))


def containment(candidate: Column, reference: Column) -> Column:
    """Share of the candidate's units that the reference also has; 0 when either side has none."""
    shared = F.size(F.array_intersect(candidate, reference))
    return F.when((F.size(candidate) == 0) | (F.size(reference) == 0), F.lit(0.0)).otherwise(
        shared / F.size(candidate)
    )


# --- near-duplicate detection ----------------------------------------------------------------------------------


def dedup_norm(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), KEEP_FOR_DEDUP, "")


def dedup_canonical(text: Column) -> Column:
    unified = F.regexp_replace(dedup_norm(text), SETTING_WORDS, SETTING_WORD)
    unified = F.regexp_replace(unified, DEDUP_HOW_WORDS, HOW_WORD)
    return F.regexp_replace(unified, DEDUP_FILLER_WORDS, "")


def bigram_set(text: Column) -> Column:
    return F.when(F.length(text) < 2, chars(text)).otherwise(grams(text, 2))


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two duplicate-free arrays; 0 when either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        shared / (F.size(a) + F.size(b) - shared)
    )


def trigram_norm(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), KEEP_FOR_TRIGRAMS, "")


# --- search ----------------------------------------------------------------------------------------------------


def search_synonyms(text: Column) -> Column:
    unified = F.regexp_replace(text, SETTING_WORDS, SETTING_WORD)
    unified = F.regexp_replace(unified, SEARCH_HOW_WORDS, HOW_WORD)
    return F.regexp_replace(unified, SEARCH_METHOD_WORDS, METHOD_WORD)


def search_norm(text: Column) -> Column:
    return F.trim(F.regexp_replace(search_synonyms(F.lower(text)), KEEP_FOR_QUALITY, " "))


def search_tokens(normalised: Column) -> Column:
    """Latin tokens, whole Han runs and the bigrams inside each run (synonyms are unified a second time)."""
    canonical = search_synonyms(normalised)
    runs = F.regexp_extract_all(canonical, F.lit(HAN_RUN), F.lit(0))
    # Bigrams never straddle runs: the second character must be Han and directly follow the first.
    pairs = F.regexp_extract_all(canonical, F.lit("(?=([\\u3400-\\u9fff]{2}))"), F.lit(1))
    latin = F.regexp_extract_all(canonical, F.lit(LATIN_TOKEN), F.lit(0))
    return F.array_distinct(F.concat(latin, runs, pairs))


def search_grams(normalised: Column) -> Column:
    compact = F.regexp_replace(normalised, " +", "")
    return (
        F.when(F.length(compact) == 0, F.array().cast("array<string>"))
        .when(F.length(compact) <= 2, F.array(compact))
        .otherwise(grams(compact, 2))
    )


def token_coverage(query: Column, candidate: Column) -> Column:
    """Share of the query's tokens found; one-character tokens count only when there is nothing longer."""
    longer = F.filter(query, lambda token: F.length(token) > 1)
    wanted = F.when(F.size(longer) > 0, longer).otherwise(query)
    return containment(wanted, candidate)


def dice(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))
    )


# --- numbers and ids -------------------------------------------------------------------------------------------


def clamp01(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def round_half_up(value: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def base36_hash(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units, printed in base 36."""
    units = F.when(
        text.rlike("[\\x{10000}-\\x{10FFFF}]"),
        F.transform(
            F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(.{4})"), F.lit(1)),
            lambda unit: F.conv(unit, 16, 10).cast("bigint"),
        ),
    ).otherwise(F.transform(F.split(text, ""), lambda ch: F.ascii(ch).cast("bigint")))
    folded = F.aggregate(
        units,
        F.lit(FNV_BASIS).cast("bigint"),
        lambda acc, unit: (acc.bitwiseXOR(unit) * F.lit(FNV_PRIME).cast("bigint")).bitwiseAND(
            F.lit(MASK_32).cast("bigint")
        ),
    )
    return F.lower(F.conv(F.when(text == "", F.lit(FNV_BASIS)).otherwise(folded).cast("string"), 10, 36))


def explode_positions(df: DataFrame, array: str, *keep: str | Column) -> DataFrame:
    """``posexplode`` into (pos, item) that evaluates the array once.

    A plain ``posexplode`` makes the optimizer infer a ``size(array) > 0`` filter and push a second copy of the whole
    array expression below it; the outer form does not, and the null row of an empty array is filtered afterwards.
    """
    return df.select(*keep, F.posexplode_outer(array).alias("pos", "item")).filter(F.col("pos").isNotNull())


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that is evaluated exactly once per row.

    A plain projection is transparent to the optimizer: a filter on the result is pushed below it by copying the whole
    expression, nested projections multiply the copies. Generated columns are not copied, and filters on other columns still
    move past them.
    """
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.explode_outer(F.array(value)).alias(name))
