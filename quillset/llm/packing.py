"""Optimal length buckets: dynamic programming over the global length histogram chooses bucket boundaries that minimise padding,
then batches within a token budget form inside each bucket.

Defined results: a null text has length 0 and goes to the first bucket like an empty one; a document longer than the whole budget is a batch
of its own; equal lengths always share a bucket; rows that repeat are placed one after the other; no rows give no rows; further
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillset.llm.shared import Scratch, gapless, own_columns

EXACT_LENGTHS, STEPS_PER_DOUBLING = 2048, 512


def word_count(text: Column) -> Column:
    """Length in white-space words, the default measure."""
    spaced = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(spaced == "", 0).otherwise(F.size(F.split(spaced, "[\\x20\\x09-\\x0D]+"))).cast("bigint")


def edge_of(length: Column) -> Column:
    """Lengths as they are up to 2,048; above, rounded up to one of 512 steps per doubling.

    That bounds the histogram at 2,048 + 512 per doubling rows whatever the corpus holds (under 20,000 up to lengths of 2^46).
    """
    step = F.greatest(F.lit(1), F.floor(F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(length - 1, F.lit(1)))) - 9)))
    return F.when(length <= EXACT_LENGTHS, length).otherwise((F.ceil(length / step) * step)).cast("bigint")


def best_edges(histogram: list[tuple[int, int, int]], buckets: int) -> list[int]:
    """Upper edges of at most ``buckets`` buckets with the least total padding.

    ``histogram``: (edge, documents, summed length) in ascending order. With C and S the running sums, a bucket over (i, j] pads
    edge_j * (C_j - C_i) - (S_j - S_i); for each added bucket the best i is the lowest of a set of lines at edge_j, kept as a hull,
    so the whole costs buckets x bins.
    """
    count, total = [0], [0]
    for _, c, s in histogram:
        count.append(count[-1] + c)
        total.append(total[-1] + s)
    n, best, choices = len(histogram), None, []
    for used in range(min(buckets, n)):
        if best is None:
            best, choice = [0] + [histogram[j - 1][0] * count[j] - total[j] for j in range(1, n + 1)], [0] * (n + 1)
        else:
            previous, best, choice, hull, at = best, [0] * (n + 1), [0] * (n + 1), [], 0
            for j in range(1, n + 1):
                i = j - 1  # the line of i may be used from j on: slope -C_i, intercept previous_i + S_i
                if i >= used:
                    line = (-count[i], previous[i] + total[i], i)
                    while len(hull) > 1 and _covered(hull[-2], hull[-1], line):
                        hull.pop()
                    hull.append(line)
                    at = min(at, len(hull) - 1)
                if not hull:
                    best[j], choice[j] = previous[j], j  # no further bucket fits below
                    continue
                x = histogram[j - 1][0]
                while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                    at += 1
                slope, intercept, i = hull[at]
                best[j], choice[j] = x * count[j] - total[j] + slope * x + intercept, i
        choices.append(choice)
    edges, j = [], n
    for choice in reversed(choices):
        if j and choice[j] != j:
            edges.append(histogram[j - 1][0])
            j = choice[j]
    return edges[::-1]


def _covered(first: tuple, middle: tuple, last: tuple) -> bool:
    """Whether the middle line is nowhere the lowest (slopes fall)."""
    return (last[1] - first[1]) * (first[0] - middle[0]) <= (middle[1] - first[1]) * (first[0] - last[0])


def pack(rows: DataFrame, buckets: int = 16, budget: int = 65536, parts: int = 256) -> DataFrame:
    """Place rows (doc_id, n_tokens) into padded batches: adds bucket, bucket_edge, padding, batch, place.

    Only the histogram (bounded, see ``edge_of``) reaches the driver. Rows of a bucket are numbered over ``parts`` parts, so no
    bucket meets in one task; batch b of a bucket holds the rows numbered from b * k on, k being how many padded rows fit the
    budget.
    """
    binned = rows.groupBy(edge_of(F.col("n_tokens")).alias("edge")).agg(F.count("*").alias("c"), F.sum("n_tokens").alias("s"), F.max("n_tokens").alias("top"))
    histogram = sorted(tuple(r) for r in binned.collect())
    tops = [r[3] for r in histogram]
    # An edge may come down to the longest length it holds: never more padding.
    edges = [tops[bisect_left([r[0] for r in histogram], e)] for e in best_edges([r[:3] for r in histogram], buckets)]
    bounds = F.array(*[F.lit(e).cast("bigint") for e in edges]) if edges else F.array(F.lit(0).cast("bigint"))
    bucket = F.size(F.filter(bounds, lambda e: e < F.col("n_tokens")))
    placed = rows.withColumn("bucket", bucket).withColumn("bucket_edge", F.element_at(bounds, bucket + 1))
    placed = placed.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    numbered = gapless(placed, "bucket", "_part", ["doc_id", "n_tokens"], "_number").drop("_part")
    fits = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bucket_edge", F.lit(1)))).cast("bigint")
    return numbered.select(
        *rows.columns,
        "bucket",
        "bucket_edge",
        (F.col("bucket_edge") - F.col("n_tokens")).alias("padding"),
        F.floor(F.col("_number") / fits).cast("bigint").alias("batch"),
        (F.col("_number") % fits).alias("place"),
    )


def pack_documents(docs: DataFrame, **options: int) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_edge, padding, batch, place for every document, lengths in words."""
    scratch = Scratch(docs.sparkSession, "packing")
    lengths = own_columns(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("bigint").alias("doc_id"), word_count(F.col("text")).alias("n_tokens"))
    return pack(scratch.store(lengths, "lengths"), **options)
