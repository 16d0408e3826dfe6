"""Facet filters, hybrid search and browsing over review records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillset.functions.text import computed_once, dice, round_half_up, search_grams, search_norm, search_tokens, token_coverage

# Field weights (in display order), blend and cut-offs.
FIELD_WEIGHTS = {"instruction": 4.0, "input": 1.25, "output": 2.2, "heading": 1.8, "fileName": 0.75}
FIELD_COLUMNS = {"heading": "source.heading", "fileName": "source.file_name"}
KEYWORD_SHARE, FUZZY_SHARE, FIELD_HIT, MIN_SCORE = 0.64, 0.36, 0.06, 0.025
BONUS_PER_FIELD, MAX_BONUS, DEFAULT_LIMIT = 0.025, 0.12, 100
MODES = ("keyword", "fuzzy", "hybrid")


def facet_filter(
    records: DataFrame,
    statuses: Sequence[str] = (),
    task_types: Sequence[str] = (),
    file_names: Sequence[str] = (),
    min_quality: float | None = None,
    max_quality: float | None = None,
) -> DataFrame:
    """Keep records passing every facet that is set; quality bounds are inclusive, an empty list does not filter."""
    for column, wanted in (("review_status", statuses), ("task_type", task_types), ("source.file_name", file_names)):
        if wanted:
            records = records.filter(F.col(column).isin(list(wanted)))
    if min_quality is not None:
        records = records.filter(F.col("quality.overall") >= min_quality)
    if max_quality is not None:
        records = records.filter(F.col("quality.overall") <= max_quality)
    return records


def search_index(records: DataFrame) -> DataFrame:
    """Add ``index``: per field its normalised text, tokens and character pairs. Store it to search repeatedly."""
    staged = records.withColumns(
        {f"__{field}": search_norm(F.coalesce(F.col(FIELD_COLUMNS.get(field, field)), F.lit(""))) for field in FIELD_WEIGHTS}
    )
    fields = [
        F.struct(
            F.col(f"__{field}").alias("text"),
            search_tokens(F.col(f"__{field}")).alias("tokens"),
            search_grams(F.col(f"__{field}")).alias("grams"),
        ).alias(field)
        for field in FIELD_WEIGHTS
    ]
    return computed_once(staged, "index", F.struct(*fields)).drop(*[f"__{field}" for field in FIELD_WEIGHTS])


def _scored(matched: DataFrame, mode: Column) -> DataFrame:
    """Add ``score`` and ``matched_fields`` from ``index`` and the query struct ``q``."""
    scores = {}
    for field in FIELD_WEIGHTS:
        entry = F.col(f"index.{field}")
        exact = F.when(entry["text"].contains(F.col("q.text")), F.lit(1.0)).otherwise(
            token_coverage(F.col("q.tokens"), entry["tokens"])
        )
        fuzzy = dice(F.col("q.grams"), entry["grams"])
        scores[f"__s_{field}"] = (
            F.when(mode == "keyword", exact)
            .when(mode == "fuzzy", fuzzy)
            .otherwise(exact * KEYWORD_SHARE + fuzzy * FUZZY_SHARE)
        )
    staged = matched.withColumns(scores)
    hits = F.array_compact(F.array(*[F.when(F.col(f"__s_{f}") > FIELD_HIT, F.lit(f)) for f in FIELD_WEIGHTS]))
    total = sum((F.col(f"__s_{f}") * w for f, w in FIELD_WEIGHTS.items()), F.lit(0.0))
    staged = computed_once(staged, "matched_fields", hits)
    n = F.size("matched_fields")
    bonus = F.when(n > 1, F.least(F.lit(MAX_BONUS), n * BONUS_PER_FIELD)).otherwise(0.0)
    score = round_half_up(total / sum(FIELD_WEIGHTS.values()) + bonus, 4)
    return computed_once(staged, "score", score).drop(*scores).filter(F.col("score") > MIN_SCORE)


def _query_struct(text: Column) -> Column:
    norm = search_norm(text)
    return F.struct(norm.alias("text"), search_tokens(norm).alias("tokens"), search_grams(norm).alias("grams"))


def search(
    records: DataFrame, query: str, mode: str = "hybrid", limit: int | None = None, position: str = "pos", **facets
) -> DataFrame:
    """Best matches first (score, overall quality, input order). Facets are applied before anything is scored.

    A query that normalises to nothing browses instead. Sorting with a limit keeps only ``limit`` rows per task.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    wanted = max(1, DEFAULT_LIMIT if limit is None else limit)
    filtered = facet_filter(records, **facets)
    if not _normalised(records, query):
        return browse(filtered, wanted, position)
    indexed = filtered if "index" in filtered.columns else search_index(filtered)
    scored = _scored(indexed.withColumn("q", _query_struct(F.lit(query))), F.lit(mode)).drop("q", "index")
    return scored.orderBy(F.desc("score"), F.desc("quality.overall"), F.asc(position)).limit(wanted)


def _normalised(records: DataFrame, query: str) -> str:
    return records.sparkSession.range(1).select(search_norm(F.lit(query)).alias("q")).first()["q"]


def browse(records: DataFrame, limit: int = DEFAULT_LIMIT, position: str = "pos") -> DataFrame:
    """Records by quality, newest first among equals; the score is the quality."""
    ranked = records.withColumns(
        {"score": F.col("quality.overall"), "matched_fields": F.array().cast("array<string>")}
    ).orderBy(F.desc("quality.overall"), F.desc("created_at"), F.asc(position))
    return ranked.limit(max(1, limit))


def search_many(records: DataFrame, queries: Sequence[tuple[str, str, str]], limit: int = DEFAULT_LIMIT, position: str = "pos") -> DataFrame:
    """Top ``limit`` per query for a list of (query_id, text, mode) given by the caller, in one pass over the records.

    The queries are a literal array on the plan; each record is scored against them in turn and only hits leave the row.
    A blank query returns the records by quality. The window's row limit is also applied map-side, so at most ``limit`` rows per query and task are shuffled.
    """
    params = F.array(
        *[F.struct(F.lit(i).alias("query_id"), F.lit(text).alias("query"), F.lit(mode).alias("mode")) for i, text, mode in queries]
    )
    indexed = records if "index" in records.columns else search_index(records)
    scores_of = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("quality.overall"), F.asc(position))
    asked = indexed.withColumn("__p", F.explode(params)).select("*", "__p.*").withColumn("q", _query_struct(F.col("query")))
    scored = _scored(asked.filter(F.col("q.text") != ""), F.col("mode")).drop("q", "index", "__p")
    found = scored.withColumn("rank", F.row_number().over(scores_of)).filter(F.col("rank") <= limit)
    # A query without words browses, as a single one does.
    browsed = asked.filter(F.col("q.text") == "").drop("q", "index", "__p")
    browsed = browsed.withColumns({"score": F.col("quality.overall"), "matched_fields": F.array().cast("array<string>")})
    newest = Window.partitionBy("query_id").orderBy(F.desc("quality.overall"), F.desc("created_at"), F.asc(position))
    browsed = browsed.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= limit)
    return found.unionByName(browsed, allowMissingColumns=True)


def page(ordered: DataFrame, number: int, size: int = 50) -> DataFrame:
    """One page of an ordered relation; sort, offset and limit run as one top-k."""
    return ordered.offset((max(1, number) - 1) * size).limit(size)


def total_pages(records: DataFrame, size: int = 50) -> DataFrame:
    return records.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("bigint").alias("total_pages"))
