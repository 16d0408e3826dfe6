"""Similarity scores used by the duplicate detectors, on precomputed set columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillset.functions.text import bigram_set, chars, codes, grams, jaccard, trigram_norm

# Weights and cut-offs of the record similarity and of the older item similarity.
QUESTION_WEIGHT, ANSWER_WEIGHT, SAME_DOCUMENT_BONUS, QUESTION_FLOOR = 0.78, 0.22, 0.03, 0.34
ITEM_QUESTION_WEIGHT, ITEM_ANSWER_WEIGHT, ITEM_QUESTION_FLOOR = 0.7, 0.3, 0.3


def lexical_sets(canonical: Column) -> Column:
    """Struct of the canonical form with its character and bigram sets (as integer codes)."""
    return F.struct(canonical.alias("canonical"), codes(chars(canonical)).alias("chars"), codes(bigram_set(canonical)).alias("pairs"))


def lexical_similarity(a: Column, b: Column) -> Column:
    """1 for equal canonical forms, otherwise the better of character and bigram Jaccard."""
    return F.when(a["canonical"] == b["canonical"], F.lit(1.0)).otherwise(
        F.greatest(jaccard(a["chars"], b["chars"]), jaccard(a["pairs"], b["pairs"]))
    )


def record_similarity(question: Column, answer: Column, same_document: Column) -> Column:
    """Weighted question/answer similarity; a question below the floor decides alone."""
    bonus = F.when(same_document, F.lit(SAME_DOCUMENT_BONUS)).otherwise(F.lit(0.0))
    blended = question * QUESTION_WEIGHT + answer * ANSWER_WEIGHT + bonus
    return F.when(question < QUESTION_FLOOR, question).otherwise(F.least(F.lit(1.0), blended))


def trigram_sets(text: Column) -> Column:
    """Struct of the normalised text and its distinct 3-grams (none for texts shorter than three)."""
    norm = trigram_norm(text)
    return F.struct(norm.alias("norm"), codes(grams(norm, 3)).alias("grams"))


def trigram_similarity(a: Column, b: Column) -> Column:
    return F.when(a["norm"] == b["norm"], F.lit(1.0)).otherwise(jaccard(a["grams"], b["grams"]))


def item_similarity(question: Column, answer: Column) -> Column:
    return F.when(question < ITEM_QUESTION_FLOOR, question).otherwise(
        question * ITEM_QUESTION_WEIGHT + answer * ITEM_ANSWER_WEIGHT
    )
