"""Duplicate detection: exact, against history, ranked near-duplicates with audit, and the older pairwise form.

None of these materialises the pairs of a group. Similar pairs are looked for inside join conditions (semi and anti joins
stop at the first hit), copies are folded together before anything is compared, and every block that is collected
into one value has a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType

from quillset.functions.similarity import (
    ANSWER_WEIGHT,
    ITEM_ANSWER_WEIGHT,
    ITEM_QUESTION_FLOOR,
    ITEM_QUESTION_WEIGHT,
    QUESTION_FLOOR,
    QUESTION_WEIGHT,
    SAME_DOCUMENT_BONUS,
    item_similarity,
    lexical_sets,
    lexical_similarity,
    record_similarity,
    trigram_sets,
    trigram_similarity,
)
from quillset.functions.text import dedup_canonical, dedup_norm, jaccard, round_half_up, trigram_norm
from quillset.session import checkpointed

# Default thresholds.
RECORD_THRESHOLD, ITEM_THRESHOLD, ROUND_THRESHOLD = 0.78, 0.88, 0.9

# Leaders settled per scope in the first round; rounds double it up to the most for which Spark still limits a ranked
# window before its shuffle. Bounds every collected array and the right side of the round's join.
BLOCK, MAX_BLOCK = 128, 1000
# Below this similarity gram prefixes no longer part the pairs of a scope.
PREFIX_FROM = 0.5
# Leader tables up to this many bytes (measured) are broadcast; larger ones are joined by a shuffle on the scope.
BROADCAST_BYTES = 64 << 20
# Without a scope every new question meets every known one: distinct questions of either side per tile (least and most), tile pairs aimed
# at in between, and rows of the blocks compared at once inside one.
TILE, MAX_TILE, TILE_PAIRS, TILE_BLOCK = 4096, 16384, 1024, 1024


def first_by_question(items: DataFrame, position: str, *scope: str) -> DataFrame:
    """Keep the first item of every normalised question. A plain aggregate, so copies combine before the shuffle."""
    others = [c for c in items.columns if c not in scope]
    keyed = items.withColumn("__norm", trigram_norm(F.col("instruction")))
    first = keyed.groupBy(*scope, "__norm").agg(F.min_by(F.struct(*others), F.col(position)).alias("__row"))
    return first.select(*scope, "__row.*").select(*items.columns)


# --- new items against what is already kept ----------------------------------------------------------------------


def _prefix(sets: DataFrame, known: DataFrame, scope: list[str], threshold: float) -> DataFrame:
    """The first grams of each row under an order all rows share, as many as a match at ``threshold`` cannot do without.

    Two sets with Jaccard at least t share an element among the first ``n - ceil(t n) + 1`` of either under one common
    order. Within scopes the order is that of the grams' hashes, which each row finds for itself; without one it is their frequency in
    ``known``, whose counting and join pay only where rare grams must tell very many rows apart.
    """
    n = F.size("s.grams")
    keep = lambda n: (n - F.ceil(n * threshold - F.lit(1e-9)) + 1).cast("int")
    if scope:
        hashed = F.array_sort(F.transform("s.grams", lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("gram"))))
        return sets.select(*scope, "__key", F.transform(F.slice(hashed, F.lit(1), keep(n)), lambda r: r["gram"]).alias("prefix"))
    frequencies = _gram_frequencies(known, scope)
    ranked = (
        sets.select(*scope, "__key", F.size("s.grams").alias("n"), F.explode("s.grams").alias("gram"))
        .join(frequencies, [*scope, "gram"], "left")
        .withColumn("freq", F.coalesce("freq", F.lit(0)))
        .groupBy(*scope, "__key", "n")
        .agg(F.array_sort(F.collect_list(F.struct("freq", "gram"))).alias("ranked"))
    )
    return ranked.select(*scope, "__key", F.transform(F.slice("ranked", F.lit(1), keep(F.col("n"))), lambda r: r["gram"]).alias("prefix"))


def _gram_frequencies(sets: DataFrame, scope: list[str]) -> DataFrame:
    return sets.select(*scope, F.explode("s.grams").alias("gram")).groupBy(*scope, "gram").agg(F.count("*").alias("freq"))


def drop_known(
    new: DataFrame, existing: DataFrame, *scope: str, threshold: float = ROUND_THRESHOLD
) -> DataFrame:
    """Keep new items whose best 3-gram similarity to any existing question of the scope is below ``threshold``."""
    keys = list(scope)
    norm = trigram_norm(F.col("instruction"))
    # Copies decide alike, so only distinct normalised questions are compared.
    fresh = new.withColumn("__norm", norm)
    known_texts = existing.select(*keys, norm.alias("__norm")).distinct()
    fresh_texts = fresh.select(*keys, "__norm").distinct()
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    unequal = fresh_texts.join(known_texts, [*keys, "__norm"], "left_anti")
    if not keys:
        dropped = _similar_to_known(unequal, known_texts, threshold).unionByName(known_texts).distinct()
        return fresh.join(dropped, "__norm", "left_anti").select(*new.columns)
    with_sets = lambda df: df.select(
        *keys, F.col("__norm").alias("__key"), trigram_sets(F.col("__norm")).alias("s")
    ).filter(F.size("s.grams") > 0)
    # Read by the prefixes and the comparison: built once.
    left, right = checkpointed(with_sets(unequal)), checkpointed(with_sets(known_texts))
    left_prefix, right_prefix = _prefix(left, right, keys, threshold), _prefix(right, right, keys, threshold)
    return _anti_similar(fresh, left, left_prefix, right, right_prefix, known_texts, keys, threshold).select(*new.columns)


def _similar_to_known(fresh: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """The ``__norm`` of ``fresh`` whose 3-gram similarity to some row of ``known`` reaches ``threshold``; both are distinct and disjoint.

    Questions of one language share most of their grams, so at low thresholds gram prefixes rule out next to nothing and every pair is met once
    per gram. Instead both sides are dealt into tiles, a task compares one pair of tiles by counting shared grams as a matrix product, and
    blocks whose set sizes rule each other out are skipped.
    """
    fresh, known = (checkpointed(df.filter(F.length("__norm") > 2).select("__norm")) for df in (fresh, known))
    n_fresh, n_known = fresh.count(), known.count()
    size = min(MAX_TILE, max(TILE, int((n_fresh * n_known / TILE_PAIRS) ** 0.5)))
    rows, columns = max(1, -(-n_fresh // size)), max(1, -(-n_known // size))
    tile = lambda n: F.pmod(F.xxhash64("__norm"), F.lit(n))
    # A fixed number of partitions: by their few bytes, tile pairs would be gathered in a handful of tasks.
    dealt = lambda df, at: df.select("__norm", F.explode(at).alias("cell")).repartition(min(2 * rows * columns, 2 * TILE_PAIRS), "cell")
    left = dealt(fresh, F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda c: tile(rows) * columns + c))
    right = dealt(known, F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: r * columns + tile(columns)))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        return pa.table({"__norm": pa.array(_similar_texts(a["__norm"].to_pylist(), b["__norm"].to_pylist(), threshold), pa.string())})

    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(compare, "__norm string").distinct()


def _gram_blocks(texts: list[str]) -> Iterator[tuple]:
    """Texts by length in blocks: (texts, row and gram of every distinct 3-gram of a row, set sizes, distinct grams)."""
    texts = sorted(texts, key=len)
    for start in range(0, len(texts), TILE_BLOCK):
        block = texts[start : start + TILE_BLOCK]
        # Normalised texts hold no character beyond 16 bits, so a row and its gram fit one integer.
        units = np.frombuffer("".join(block).encode("utf-16-le"), dtype="<u2").astype(np.int64)
        row = np.repeat(np.arange(len(block)), [len(t) for t in block])
        inside = row[2:] == row[:-2]
        gram = (units[:-2] << 32 | units[1:-1] << 16 | units[2:])[inside]
        both = np.unique(row[2:][inside] << 48 | gram)
        row, gram = both >> 48, both & ((1 << 48) - 1)
        yield block, row, gram, np.bincount(row, minlength=len(block)), np.unique(gram)


def _shared_grams(row: np.ndarray, gram: np.ndarray, rows: int, wanted: np.ndarray) -> np.ndarray:
    """Which of the ``wanted`` grams each row has, as 0 and 1."""
    at = np.minimum(np.searchsorted(wanted, gram), len(wanted) - 1)
    has = wanted[at] == gram
    table = np.zeros((rows, len(wanted)), dtype=np.float32)
    table[row[has], at[has]] = 1
    return table


def _similar_texts(fresh: list[str], known: list[str], threshold: float) -> list[str]:
    """Those of ``fresh`` that reach ``threshold`` with any of ``known``."""
    found, against = [], list(_gram_blocks(known))
    for texts, row, gram, size, grams in _gram_blocks(fresh):
        hit = np.zeros(len(texts), dtype=bool)
        for others, o_row, o_gram, o_size, o_grams in against:
            if min(size.max(), o_size.max()) < threshold * max(size.min(), o_size.min()) - 1e-6:
                continue
            common = np.intersect1d(grams, o_grams, assume_unique=True)
            shared = np.zeros((len(texts), len(others)), dtype=np.float32)
            # Counts of ones are exact in single precision; the slices bound the tables whatever the alphabet.
            for part in np.split(common, range(4096, len(common), 4096)):
                if len(part):
                    shared += _shared_grams(row, gram, len(texts), part) @ _shared_grams(o_row, o_gram, len(others), part).T
            union = size[:, None] + o_size[None, :] - shared.astype(np.float64)
            hit |= (shared.astype(np.float64) / union >= threshold).any(axis=1)
        found += [text for text, is_hit in zip(texts, hit, strict=True) if is_hit]
    return found


def _anti_similar(fresh, left, left_prefix, right, right_prefix, known_texts, keys, threshold) -> DataFrame:
    probe = _exploded(left, left_prefix, keys).alias("a")
    build = _exploded(right, right_prefix, keys).alias("b")
    condition = _may_reach(keys, threshold) & (jaccard(F.col("a.grams"), F.col("b.grams")) >= threshold)
    similar = probe.join(build, condition, "left_semi").select(*keys, F.col("key").alias("__norm")).distinct()
    dropped = similar.unionByName(known_texts).distinct()
    return fresh.join(dropped, [*keys, "__norm"], "left_anti")


def _exploded(sets: DataFrame, prefix: DataFrame, keys: list[str]) -> DataFrame:
    """One row per prefix gram: (key, grams, n, at, gram)."""
    joined = sets.join(prefix, [*keys, "__key"])
    return joined.select(
        *keys, F.col("__key").alias("key"), F.col("s.grams").alias("grams"), F.size("s.grams").alias("n"), F.posexplode("prefix").alias("at", "gram")
    )


def _may_reach(keys: list[str], threshold: float) -> Column:
    """Rows of sides a and b that share a prefix gram and whose sizes and positions still allow ``threshold``.

    Seen from the first gram two sets share, at most what follows it on either side is shared too; a pair failing the
    bound at a later gram has been judged at an earlier one.
    """
    condition = F.col("a.gram") == F.col("b.gram")
    for key in keys:
        condition = condition & (F.col(f"a.{key}") == F.col(f"b.{key}"))
    most = 1 + F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")) - 1
    return condition & (most >= (F.col("a.n") + F.col("b.n")) * (threshold / (1 + threshold)) - 1e-6)


def average_similarity(new: DataFrame, previous: DataFrame, *scope: str) -> DataFrame:
    """Mean question similarity over all (new, previous) pairs of each scope, 0 when either side is empty.

    Equal questions are folded into one weighted row first, and the previous side is hashed into blocks of about ``BLOCK``
    distinct questions, so a row meets blocks and the pairs themselves live only inside one expression.
    """
    keys = list(scope)
    weighted = lambda df: (
        df.groupBy(*keys, trigram_norm(F.col("instruction")).alias("norm")).agg(F.count("*").alias("weight"))
    )
    left = weighted(new).withColumn("s", trigram_sets(F.col("norm")))
    right = weighted(previous).withColumn("s", trigram_sets(F.col("norm")))
    blocks_of = right.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    blocks = (
        right.join(blocks_of, keys)
        .groupBy(*keys, F.pmod(F.xxhash64("norm"), F.col("blocks")).alias("block"))
        .agg(F.collect_list(F.struct("weight", "s")).alias("members"))
    )
    sums = F.aggregate(
        "members", F.lit(0.0), lambda acc, m: acc + trigram_similarity(F.col("s"), m["s"]) * m["weight"].cast("double")
    )
    paired = left.join(blocks, keys).select(*keys, (sums * F.col("weight")).alias("part"))
    totals = paired.groupBy(*keys).agg(F.sum("part").alias("total"))
    n_new = new.groupBy(*keys).agg(F.count("*").alias("n_new"))
    n_prev = previous.groupBy(*keys).agg(F.count("*").alias("n_previous"))
    counted = n_new.join(n_prev, keys, "left").join(totals, keys, "left")
    mean = F.col("total") / (F.col("n_new") * F.col("n_previous"))
    return counted.select(*keys, F.coalesce(mean, F.lit(0.0)).alias("avg_similarity"))


# --- ranked near-duplicates ----------------------------------------------------------------------------------------


def _rank_key() -> Column:
    """Best record first: overall, groundedness, answer length, then input order."""
    return F.struct(
        (-F.col("quality.overall")).alias("o"),
        (-F.col("quality.groundedness")).alias("g"),
        (-F.length("output")).alias("l"),
        F.col("__pos").alias("p"),
    )


def _pair_similarity(a: Column, b: Column, question: Column | None = None) -> Column:
    question = lexical_similarity(a["q"], b["q"]) if question is None else question
    return record_similarity(question, lexical_similarity(a["a"], b["a"]), a["document_id"] == b["document_id"])


def _reaches(a: Column, b: Column, threshold: float) -> Column:
    """Whether two classes are at least ``threshold`` similar, cheapest tests first.

    A blended score can only get there when the question alone reaches ``least``, and a Jaccard score never exceeds
    the ratio of the set sizes, so most pairs are ruled out by two integer comparisons.
    """
    if threshold <= QUESTION_FLOOR:
        return _pair_similarity(a, b) >= threshold
    least = max(QUESTION_FLOOR, (threshold - ANSWER_WEIGHT - SAME_DOCUMENT_BONUS) / QUESTION_WEIGHT - 1e-9)
    ratio = lambda x, y: F.least(F.size(x), F.size(y)) >= F.greatest(F.size(x), F.size(y)) * least
    q, p = a["q"], b["q"]
    possible = (q["canonical"] == p["canonical"]) | ratio(q["chars"], p["chars"]) | ratio(q["pairs"], p["pairs"])
    question = lexical_similarity(q, p)
    return possible & (question >= least) & (_pair_similarity(a, b, question) >= threshold)


def near_duplicates(
    records: DataFrame, *scope: str, position: str = "pos", threshold: float = RECORD_THRESHOLD, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """Which records stay and which record captured each of the others.

    Returns ``(kept, captured)``: kept has (scope, pos); captured has (scope, pos, kept_pos, similarity). The result equals scanning each
    scope from the best record to the worst, a record joining the most similar record already kept (the better ranked on
    a tie) when they reach ``threshold`` and being kept otherwise.

    Records with equal canonical question and answer in one document behave alike, so each such class is represented by its
    best record. Rounds then settle the best ``block`` undecided classes of every scope and drop all others that
    match a new leader; a round costs one anti join against at most ``block`` leaders per scope.
    """
    keys = list(scope)
    slim = records.withColumn("__pos", F.col(position)).select(
        *keys,
        F.col("__pos").alias("pos"),
        _rank_key().alias("rank"),
        F.col("source.document_id").alias("document_id"),
        dedup_canonical(F.col("instruction")).alias("q"),
        dedup_canonical(F.col("output")).alias("a"),
    )
    ranked = checkpointed(slim)
    class_keys = [*keys, "document_id", "q", "a"]
    best = ranked.groupBy(*class_keys).agg(F.min("rank").alias("rank"))
    classes = checkpointed(
        best.select(
            *keys,
            F.col("rank.p").alias("leader"),
            F.struct("rank", "document_id", lexical_sets(F.col("q")).alias("q"), lexical_sets(F.col("a")).alias("a")).alias("c"),
        )
    )
    rounds = _settle(classes, keys, threshold, block)

    # Who captured whom: each class against the kept ones above the threshold, best similarity first.
    matches = _matches(classes, rounds, keys, threshold)
    member_of = ranked.join(best.select(*class_keys, F.col("rank.p").alias("leader")), class_keys)
    kept = _union(rounds).select(*keys, F.col("c.rank.p").alias("pos"))
    others = member_of.join(kept, [*keys, "pos"], "left_anti")
    earlier = F.filter("kept", lambda k: k["rank"] < F.col("rank"))
    choice = F.array_max(
        F.transform(
            earlier,
            lambda k: F.struct(
                k["similarity"].alias("similarity"),
                # Ranks ascend, so the negated parts make the better ranked record the larger one.
                (-k["rank"]["o"]).alias("o"),
                (-k["rank"]["g"]).alias("g"),
                (-k["rank"]["l"]).alias("l"),
                (-k["rank"]["p"]).alias("p"),
            ),
        )
    )
    captured = others.join(matches, [*keys, "leader"]).withColumn("__choice", choice).select(
        *keys, "pos", (-F.col("__choice.p")).alias("kept_pos"), F.col("__choice.similarity").alias("similarity")
    )
    return kept, captured


def _settle(classes: DataFrame, keys: list[str], threshold: float, block: int) -> list[DataFrame]:
    """The leaders found by each round."""
    undecided, rounds = classes, []
    while True:
        fresh = checkpointed(_greedy(_top_block(undecided, keys, block), keys, threshold))
        rounds.append(fresh)
        undecided = checkpointed(_without_matches(undecided, fresh, keys, threshold))
        if undecided.isEmpty():
            return rounds
        block = min(2 * block, MAX_BLOCK)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _fits_broadcast(leaders: DataFrame) -> bool:
    texts = F.length("c.q.canonical") + F.length("c.a.canonical")
    units = F.size("c.q.chars") + F.size("c.q.pairs") + F.size("c.a.chars") + F.size("c.a.pairs")
    used = leaders.agg(F.sum(200 + 3 * texts + 8 * units).alias("bytes")).first()["bytes"]
    return (used or 0) <= BROADCAST_BYTES


def _top_block(classes: DataFrame, keys: list[str], block: int) -> DataFrame:
    """The best ``block`` classes of each scope; the row_number limit is applied before the shuffle as well as after."""
    scope = [F.col(k) for k in keys] or [F.lit(0)]
    order = Window.partitionBy(*scope).orderBy(F.col("c.rank"))
    return classes.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= block).drop("__n")


def _greedy(top: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Scan one bounded block per scope from best to worst, keeping what matches nothing kept before it."""
    packed = top.groupBy(*keys).agg(F.array_sort(F.collect_list("c")).alias("block"))
    nothing = F.slice(F.col("block"), 1, 0)
    kept = F.aggregate(
        "block",
        nothing,
        lambda acc, c: F.when(F.exists(acc, lambda k: _reaches(k, c, threshold)), acc).otherwise(
            F.concat(acc, F.array(c))
        ),
    )
    unpacked = packed.select(*keys, F.explode_outer(kept).alias("c")).filter(F.col("c").isNotNull())
    return unpacked.select(*keys, F.col("c.rank.p").alias("leader"), "c")


def _meet(classes: DataFrame, leaders: DataFrame, keys: list[str], condition: Column, how: str) -> DataFrame:
    """Join classes ``a`` with leaders ``b`` of the same scope under ``condition``."""
    right = leaders.select(*keys, F.col("c").alias("k"))
    if _fits_broadcast(leaders):
        right = F.broadcast(right)
    for key in keys:
        condition = condition & F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))
    return classes.alias("a").join(right.alias("b"), condition, how)


def _without_matches(undecided: DataFrame, leaders: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Undecided classes that are neither a leader nor similar to one."""
    itself = F.col("b.k.rank.p") == F.col("a.leader")
    return _meet(undecided, leaders, keys, itself | _reaches(F.col("b.k"), F.col("a.c"), threshold), "left_anti").select("a.*")


def _matches(classes: DataFrame, rounds: list[DataFrame], keys: list[str], threshold: float) -> DataFrame:
    """Per class, the kept records that reach the threshold with it (kept records are mutually dissimilar, so few).

    Without a scope there is nothing to shuffle on, so leaders too many to broadcast at once are met round by round.
    """
    together = _union(rounds)
    groups = [together] if keys or _fits_broadcast(together) else rounds
    similarity = _pair_similarity(F.col("b.k"), F.col("a.c"))
    condition = _reaches(F.col("b.k"), F.col("a.c"), threshold)

    def pairs(leaders: DataFrame) -> DataFrame:
        found = _meet(classes, leaders, keys, condition, "inner").select(
            *[F.col(f"a.{key}") for key in keys],
            F.col("a.leader").alias("leader"),
            F.struct(F.col("b.k.rank").alias("rank"), similarity.alias("similarity")).alias("kept"),
        )
        return found if len(groups) == 1 else checkpointed(found)

    return _union([pairs(leaders) for leaders in groups]).groupBy(*keys, "leader").agg(F.collect_list("kept").alias("kept"))


def deduplicate_records(
    records: DataFrame, *scope: str, position: str = "pos", threshold: float = RECORD_THRESHOLD
) -> tuple[DataFrame, DataFrame]:
    """Kept records and the audit child table of what each of them absorbed."""
    kept, captured = near_duplicates(records, *scope, position=position, threshold=threshold)
    keys = list(scope)
    kept_rows = records.join(kept.withColumnRenamed("pos", position), [*keys, position], "left_semi")
    return kept_rows, captured


def duplicate_groups(records: DataFrame, captured: DataFrame, *scope: str, position: str = "pos") -> DataFrame:
    """One row per kept record that absorbed others: how many, best similarity, exact or near.

    The members stay rows of :func:`duplicate_audit` (``group_id``); a group of copies may be too large for one array.
    """
    joined = duplicate_audit(records, captured, *scope, position=position)
    grouped = joined.groupBy(*scope, "group_id", "kept_id").agg(
        F.count("*").alias("duplicates"), F.max("similarity").alias("similarity"), F.bool_and("same_question").alias("exact")
    )
    reason = F.when(F.col("exact"), "exact").otherwise("near_duplicate")
    return grouped.withColumn("reason", reason).drop("exact")


def duplicate_audit(records: DataFrame, captured: DataFrame, *scope: str, position: str = "pos") -> DataFrame:
    """Every removed record with the kept one that absorbed it and their similarity (3 decimals)."""
    keys = list(scope)
    norm = dedup_norm(F.col("instruction"))
    removed = records.select(*keys, F.col(position).alias("pos"), "id", norm.alias("norm")).join(captured, [*keys, "pos"])
    kept = records.select(*keys, F.col(position).alias("kept_pos"), F.col("id").alias("kept_id"), norm.alias("kept_norm"))
    return removed.join(kept, [*keys, "kept_pos"]).select(
        *keys,
        F.concat(F.lit("dup_"), "kept_id").alias("group_id"),
        "kept_id",
        F.col("id").alias("duplicate_id"),
        "pos",
        "kept_pos",
        round_half_up(F.col("similarity"), 3).alias("similarity"),
        (F.col("norm") == F.col("kept_norm")).alias("same_question"),
    )


# --- the older pairwise form ---------------------------------------------------------------------------------------


def longer_answer_wins(items: DataFrame, *scope: str, position: str = "pos", threshold: float = ITEM_THRESHOLD) -> DataFrame:
    """Pairwise removal in input order in which the item with the longer answer survives.

    Item i, when its turn comes, is compared with the later ones still alive: a similar one that is not longer is removed, and the
    first longer one removes i and ends its turn. The outcome depends on order but only similar pairs change anything, so
    edges are found by a prefix join over distinct (question, answer, length) classes and the turns are replayed within
    each connected component. A scope is one run over one document, which the upload limit bounds.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    keys = list(scope)
    classed = items.select(
        *keys,
        F.col(position).alias("pos"),
        trigram_norm(F.col("instruction")).alias("q"),
        trigram_norm(F.col("output")).alias("a"),
        F.length("output").alias("len"),
    )
    classed = classed.withColumn("cls", F.xxhash64("q", "a", "len"))
    folded = classed.groupBy(*keys, "cls").agg(F.first("q").alias("q"), F.first("a").alias("a"), F.count("*").alias("copies"))
    classes = checkpointed(folded.withColumn("a", trigram_sets(F.col("a"))))
    edges = checkpointed(_class_edges(classes, keys, threshold))
    # Copies that resemble nothing else: the first removes the rest, whatever their number.
    alone = classes.filter("copies > 1").select(*keys, "cls").join(edges, [*keys, "cls"], "left_anti")
    copies = classed.join(alone, [*keys, "cls"], "left_semi")
    first = copies.groupBy(*keys, "cls").agg(F.min("pos").alias("first"))
    extra = copies.join(first, [*keys, "cls"]).filter(F.col("pos") > F.col("first")).select(*keys, "pos")
    # Everything else is replayed per component, many components to a batch.
    labels = _components(edges.select(*keys, "cls").distinct(), edges, keys)
    group = [*keys, "component"]
    turns = classed.select(*keys, "cls", "pos", "len").join(labels, [*keys, "cls"])
    packed = turns.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("pos", "cls", "len"))).alias("turns"))
    wires = edges.join(labels, [*keys, "cls"]).groupBy(*group).agg(F.collect_list(F.struct("cls", "other")).alias("wires"))
    lost = packed.join(wires, group).withColumn("lost", _replay_udf()("turns", "wires"))
    removed = extra.unionByName(lost.select(*keys, F.explode_outer("lost").alias("pos")).filter("pos IS NOT NULL"))
    return items.join(removed.withColumnRenamed("pos", position), [*keys, position], "left_anti")


def _class_edges(classes: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Similar class pairs, in both directions."""
    least = threshold if threshold <= ITEM_QUESTION_FLOOR else max(
        ITEM_QUESTION_FLOOR, (threshold - ITEM_ANSWER_WEIGHT) / ITEM_QUESTION_WEIGHT
    )
    questions = classes.select(*keys, F.col("q").alias("__key")).distinct()
    sets = checkpointed(questions.withColumn("s", trigram_sets(F.col("__key"))))
    filled = sets.filter(F.size("s.grams") > 0)
    close = jaccard(F.col("a.grams"), F.col("b.grams"))
    if keys and least < PREFIX_FROM:
        # Most of a set would be its prefix, and a pair would be judged at every gram it shares there: meet it once instead.
        side = filled.select(*keys, F.col("__key").alias("key"), F.col("s.grams").alias("grams"), F.size("s.grams").alias("n"))
        a, b = side.alias("a"), side.alias("b")
        meet = F.least(F.col("a.n"), F.col("b.n")) >= F.greatest(F.col("a.n"), F.col("b.n")) * least - 1e-6
        for key in keys:
            meet = meet & (F.col(f"a.{key}") == F.col(f"b.{key}"))
    else:
        prefix = _prefix(filled, sets, keys, least)
        a, b, meet = _exploded(sets, prefix, keys).alias("a"), _exploded(sets, prefix, keys).alias("b"), _may_reach(keys, least)
    near = (
        a.join(b, meet & (F.col("a.key") < F.col("b.key")) & (close >= least - 1e-9))
        .select(*[F.col(f"a.{key}") for key in keys], F.col("a.key").alias("q1"), F.col("b.key").alias("q2"), close.alias("qs"))
        # A pair may meet at several grams.
        .distinct()
    )
    side = lambda n: classes.select(*keys, F.col("q").alias(f"q{n}"), F.col("cls").alias(f"c{n}"), F.col("a").alias(f"a{n}"))
    answer = trigram_similarity(F.col("a1"), F.col("a2"))
    different = near.join(side(1), [*keys, "q1"]).join(side(2), [*keys, "q2"]).filter(item_similarity(F.col("qs"), answer) >= threshold)
    same = side(1).join(side(2).withColumnRenamed("q2", "q1"), [*keys, "q1"]).filter("c1 < c2")
    same = same.filter(item_similarity(F.lit(1.0), answer) >= threshold)
    pairs = different.select(*keys, "c1", "c2").unionByName(same.select(*keys, "c1", "c2"))
    return pairs.select(*keys, F.col("c1").alias("cls"), F.col("c2").alias("other")).unionByName(
        pairs.select(*keys, F.col("c2").alias("cls"), F.col("c1").alias("other"))
    )


def _components(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest class id reachable from each class; every round also jumps along the label found so far."""
    labels = checkpointed(nodes.withColumn("component", F.col("cls")))
    while True:
        offered = edges.join(labels.withColumnRenamed("cls", "other"), [*keys, "other"]).groupBy(*keys, "cls").agg(F.min("component").alias("near"))
        step = labels.join(offered, [*keys, "cls"], "left").select(
            *keys, "cls", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component")
        )
        jump = step.select(*keys, F.col("cls").alias("component"), F.col("component").alias("far"))
        moved = checkpointed(
            step.join(jump, [*keys, "component"], "left").select(
                *keys, "cls", "old", F.least("component", F.coalesce("far", "component")).alias("component")
            )
        )
        labels = moved.drop("old")
        if moved.filter("component <> old").isEmpty():
            return labels


def _replay(turns: list, wires: list) -> list:
    """Positions removed by the turns of one component."""
    near: dict = {}
    for wire in wires:
        near.setdefault(wire["cls"], {wire["cls"]}).add(wire["other"])
    where: dict = {}
    for at, turn in enumerate(turns):
        where.setdefault(turn["cls"], []).append(at)
    dead: set = set()
    for at, turn in enumerate(turns):
        if at in dead:
            continue
        for n in sorted(n for c in near[turn["cls"]] for n in where[c] if n > at and n not in dead):
            if turns[n]["len"] > turn["len"]:
                dead.add(at)
                break
            dead.add(n)
    return [turns[at]["pos"] for at in sorted(dead)]


def _replay_udf():
    @pandas_udf(ArrayType(LongType()))
    def replay(turns: pd.Series, wires: pd.Series) -> pd.Series:
        return pd.Series([_replay(t, w) for t, w in zip(turns, wires)], dtype=object)

    return replay
