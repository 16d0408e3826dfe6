"""Heuristic quality scores, task types and record ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillset.functions.text import base36_hash, clamp01, computed_once, containment, is_blank, js_trim, quality_norm, round_half_up, text_units

# Length bands with their scores, weights, word lists and flag texts.
SHORT_ANSWER, MEDIUM_ANSWER, LONG_ANSWER = 8, 20, 1800
SCORE_SHORT, SCORE_MEDIUM, SCORE_LONG, SCORE_GOOD = 0.25, 0.62, 0.7, 0.92
QUESTION_MIN, QUESTION_MAX, CLEAR, UNCLEAR, VAGUE_PENALTY = 5, 160, 0.94, 0.55, 0.28
RELEVANCE_SLOPE, RELEVANCE_BASE = 0.55, 0.42
WEIGHTS_WITH_EVIDENCE = (0.42, 0.2, 0.2, 0.18)
WEIGHTS_WITHOUT_EVIDENCE = (0.34, 0.34, 0.32)
VAGUE_START = "^(这|那|它|其|上述|以下|文中|该内容|这个)"
LOW_INFORMATION = "详见|如上|略|无法回答"
EXTRACTION_WORDS = "提取|列出|找出|抽取"
ANALYSIS_WORDS = "分析|比较|为什么|原因|影响"
STRONG_FROM, MEDIUM_FROM = 0.8, 0.65
FLAG_NO_EVIDENCE = "原文证据不可用，忠实度需要人工复核"
FLAG_LOW_OVERLAP = "答案与原文证据词面重合度较低，需要人工核验"
FLAG_TOO_SHORT = "回答过短，可能不完整"
FLAG_VAGUE = "问题依赖模糊指代，脱离上下文后可能难以理解"
FLAG_LOW_INFORMATION = "回答包含低信息量表述"
FLAG_TOO_LONG = "字段过长，建议拆分"


def with_quality(
    df: DataFrame, evidence: Column | None = None, available: Column | None = None, name: str = "quality"
) -> DataFrame:
    """Score (instruction, input, output) against its evidence; adds one struct column.

    ``evidence`` and ``available`` default to the record's ``source``. The weighted total uses unrounded parts.
    """
    evidence = F.col("source.text") if evidence is None else evidence
    available = F.coalesce(F.col("source.available"), F.lit(True)) if available is None else available
    question, answer = F.col("instruction"), F.col("output")
    staged = df.withColumns(
        {
            "__available": available,
            "__q": text_units(question),
            "__a": text_units(answer),
            "__e": text_units(evidence),
            "__q_len": F.length(quality_norm(question)),
            "__a_len": F.length(quality_norm(answer)),
        }
    )
    vague = js_trim(question).rlike(VAGUE_START) & is_blank(F.col("input"))
    a_len = F.col("__a_len")
    parts = {
        "__g": F.when(F.col("__available"), clamp01(containment(F.col("__a"), F.col("__e")))).otherwise(F.lit(0.0)),
        "__co": F.when(a_len < SHORT_ANSWER, SCORE_SHORT)
        .when(a_len < MEDIUM_ANSWER, SCORE_MEDIUM)
        .when(a_len > LONG_ANSWER, SCORE_LONG)
        .otherwise(SCORE_GOOD),
        "__cl": clamp01(
            F.when(F.col("__q_len").between(QUESTION_MIN, QUESTION_MAX), CLEAR).otherwise(UNCLEAR)
            - F.when(vague, VAGUE_PENALTY).otherwise(0.0)
        ),
        "__r": clamp01(
            F.greatest(containment(F.col("__q"), F.col("__e")), containment(F.col("__q"), F.col("__a"))) * RELEVANCE_SLOPE
            + RELEVANCE_BASE
        ),
    }
    staged = staged.withColumns(parts)
    g, co, cl, r = (F.col(c) for c in parts)
    w, v = WEIGHTS_WITH_EVIDENCE, WEIGHTS_WITHOUT_EVIDENCE
    overall = clamp01(
        F.when(F.col("__available"), g * w[0] + co * w[1] + cl * w[2] + r * w[3]).otherwise(co * v[0] + cl * v[1] + r * v[2])
    )
    flags = F.array_compact(
        F.array(
            F.when(~F.col("__available"), FLAG_NO_EVIDENCE).when(g < 0.45, FLAG_LOW_OVERLAP),
            F.when(co < 0.5, FLAG_TOO_SHORT),
            F.when(cl < 0.7, FLAG_VAGUE),
            F.when(answer.rlike(LOW_INFORMATION), FLAG_LOW_INFORMATION),
            F.when((F.length(question) > 500) | (F.length(answer) > 4000), FLAG_TOO_LONG),
        )
    )
    quality = F.struct(
        round_half_up(g, 3).alias("groundedness"),
        round_half_up(co, 3).alias("completeness"),
        round_half_up(cl, 3).alias("clarity"),
        round_half_up(r, 3).alias("relevance"),
        round_half_up(overall, 3).alias("overall"),
        flags.alias("flags"),
        F.lit("heuristic_prescreen").alias("method"),
        F.col("__available").alias("evidence_available"),
    )
    return computed_once(staged, name, quality).drop("__available", "__q", "__a", "__e", "__q_len", "__a_len", *parts)


def infer_task_type() -> Column:
    return (
        F.when(~is_blank(F.col("input")), "reading_comprehension")
        .when(F.col("instruction").rlike(EXTRACTION_WORDS), "extraction")
        .when(F.col("instruction").rlike(ANALYSIS_WORDS), "analysis")
        .otherwise("closed_book_qa")
    )


def quality_tone(overall: Column) -> Column:
    return F.when(overall >= STRONG_FROM, "strong").when(overall >= MEDIUM_FROM, "medium").otherwise("attention")


def record_id() -> Column:
    return F.concat(
        F.lit("qa_"), base36_hash(F.concat_ws("|", F.col("source.document_id"), F.col("source.chunk_id"), "instruction", "output"))
    )


def trim_fields(items: DataFrame) -> DataFrame:
    return items.withColumns(
        {
            "instruction": js_trim(F.col("instruction")),
            "input": js_trim(F.coalesce(F.col("input"), F.lit(""))),
            "output": js_trim(F.col("output")),
        }
    )


def build_records(items: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Items with a ``source`` become review records: trimmed, scored, typed, identified, pending."""
    scored = with_quality(trim_fields(items))
    created = F.unix_millis(F.current_timestamp()) if created_at is None else created_at
    return scored.withColumns(
        {
            "id": record_id(),
            "review_status": F.lit("pending"),
            "task_type": infer_task_type(),
            "created_at": created.cast("bigint"),
        }
    )


def rescore(records: DataFrame) -> DataFrame:
    """Score again after an edit; id, status and task type stay as they are."""
    return with_quality(records)
