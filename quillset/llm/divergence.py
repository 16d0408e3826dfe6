"""How far the sources of a language differ in their terms: partial counts by Arrow compute functions, merged into columnar shards of terms.

Inside ``mapInArrow``, ``ascii_lower``, ``split_pattern_regex``, ``dictionary_encode`` and two hash ``group_by`` calls turn slices of texts into partial counts
per (lang, source, term); Spark merges them. A language keeps the terms of at least ``min_docs`` of its documents (rows). A shard holds all counts
of some terms of one language, so the counts of a hot source or language are dealt over many shards; it adds up its share of every divergence and its own
best terms, and only these sums and lists meet again.

All arithmetic is exact in integers: p = 1 + floor(10^9 (count + 1) / (N + V)) and f = floor((p - q)^2 / q), with N the kept terms' occurrences
in the group, V the language's kept terms and q the other side's p. Sums stay below 2^63 while V is at most 10^9.

Defined results: null text, lang or source counts as ''; empty texts have no terms but their (lang, source) group occurs; a language without kept terms has
divergences of 0; a language with one source has no ``pair`` rows; repeated rows count as documents of their own; ties rank by the item's UTF-8 bytes; no
rows give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillset.llm.shared import Scratch, own_columns

BETWEEN_TERMS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE, SLICE_BYTES, BLOCK_CELLS = 10**9, 8_000_000, 2_000_000


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of about ``SLICE_BYTES`` of text; a longer text is a part of its own."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(ends // SLICE_BYTES)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def _texts(docs: DataFrame) -> DataFrame:
    empty = F.lit("")
    return own_columns(docs, lang=F.coalesce(F.col("lang").cast("string"), empty), source=F.coalesce(F.col("source").cast("string"), empty), text=F.coalesce(F.col("text").cast("string"), empty))


def partial_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs: one row per slice of texts and distinct triple."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                words = pc.split_pattern_regex(pc.ascii_lower(part.column("text")), pattern=BETWEEN_TERMS)
                row, term = pc.list_parent_indices(words), pc.list_flatten(words)
                some = pc.not_equal(term, "")
                coded = pc.dictionary_encode(term.filter(some))
                each = pa.table({"row": row.filter(some), "term": coded.indices}).group_by(["row", "term"]).aggregate([([], "count_all")])
                lang, source = (pc.dictionary_encode(part.column(c)) for c in ("lang", "source"))
                keyed = pa.table({"lang": lang.indices.take(each["row"]), "source": source.indices.take(each["row"]), "term": each["term"], "n": each["count_all"]})
                merged = keyed.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ([], "count_all")]).combine_chunks()
                decoded = [coded_.dictionary.take(merged[name]).combine_chunks() for name, coded_ in (("lang", lang), ("source", source), ("term", coded))]
                counts = [merged[name].combine_chunks().cast(pa.int64()) for name in ("n_sum", "count_all")]
                if merged.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in decoded + counts], names=["lang", "source", "term", "n", "docs"])

    return _texts(docs).mapInArrow(work, "lang string, source string, term string, n bigint, docs bigint")


def scaled(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total), digit by digit, so that nothing leaves 64 bits while total < 9 * 10^17."""
    rest, out = counts.astype(np.int64) + 1, np.zeros(len(counts), dtype=np.int64)
    out, rest = rest // total, rest % total
    for _ in range(9):
        rest = rest * 10
        out = out * 10 + rest // total
        rest %= total
    return out + 1


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _shard(table: pa.Table, top: int) -> pa.Table:
    """One shard's share of all divergences (part ``pair``) and its best ``top`` terms of each source (part ``term``).

    Rows without a term name the sources of the language with their N, the language's V and its own N.
    """
    lang, shard_terms = table["lang"][0].as_py(), pc.is_valid(table["term"])
    heads = table.filter(pc.invert(shard_terms)).sort_by("source")
    rows = table.filter(shard_terms)
    sources, kept, lang_total = heads["source"].to_pylist(), heads["kept"][0].as_py(), heads["lang_n"][0].as_py()
    totals = [n + kept for n in heads["group_n"].to_pylist()]
    coded = pc.dictionary_encode(rows["term"].combine_chunks()) if rows.num_rows else None
    terms = coded.dictionary.to_pylist() if coded is not None else []
    at = coded.indices.to_numpy() if coded is not None else np.zeros(0, dtype=np.int64)
    source_at = np.array([sources.index(s) for s in pc.unique(rows["source"]).to_pylist()], dtype=np.int64)
    which = source_at[pc.dictionary_encode(rows["source"].combine_chunks()).indices.to_numpy()] if rows.num_rows else np.zeros(0, dtype=np.int64)
    counts = rows["n"].to_numpy()
    in_lang = np.zeros(len(terms), dtype=np.int64)
    np.add.at(in_lang, at, counts)
    usual = scaled(in_lang, lang_total + kept) if terms else in_lang
    sums, best = np.zeros((len(sources),) * 2, dtype=np.int64), []
    width = max(1, BLOCK_CELLS // len(sources))
    order = np.argsort(at, kind="stable")
    starts = np.searchsorted(at[order], np.arange(0, len(terms) + width, width))
    for k, low in enumerate(range(0, len(terms), width)):
        here, size = order[starts[k] : starts[k + 1]], min(width, len(terms) - low)
        grid = np.zeros((len(sources), size), dtype=np.int64)
        grid[which[here], at[here] - low] = counts[here]
        p = np.stack([scaled(line, total) for line, total in zip(grid, totals, strict=True)])
        for i in range(len(sources)):
            sums[i] += excess(p[i][None, :], p).sum(axis=1)
            over = np.flatnonzero((grid[i] > 0) & (p[i] > usual[low : low + size]))
            best += [(i, int(v), terms[low + j]) for j, v in zip(over.tolist(), excess(p[i][over], usual[low + over]).tolist(), strict=True)]
    best.sort(key=lambda b: (b[0], -b[1], b[2].encode()))
    seen: dict[int, int] = {}
    kept_best = []
    for b in best:
        seen[b[0]] = seen.get(b[0], 0) + 1
        if seen[b[0]] <= top:
            kept_best.append(b)
    pairs = [(sources[i], "pair", sources[j], int(sums[i, j])) for i in range(len(sources)) for j in range(len(sources)) if i != j]
    out = pairs + [(sources[i], "term", term, v) for i, v, term in kept_best]
    columns = list(zip(*out, strict=True)) or [[]] * 4
    return pa.table({"lang": pa.array([lang] * len(out), pa.string())} | {n: pa.array(c, t) for n, c, t in zip(("source", "part", "item", "value"), columns, (pa.string(),) * 3 + (pa.int64(),), strict=True)})


def source_divergences(docs: DataFrame, min_docs: int = 3, top: int = 200, shard_rows: int = 50_000) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the language with its divergence, and the terms a source uses most beyond its language."""
    scratch = Scratch(docs.sparkSession, "divergence")
    groups = scratch.store(_texts(docs).select("lang", "source").distinct(), "groups")
    merged = partial_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")  # at most one row per source
    spread = merged.withColumn("in_docs", F.sum("docs").over(of_term)).withColumn("first", F.col("source") == F.min("source").over(of_term))
    kept = scratch.store(spread.filter(F.col("in_docs") >= min_docs).select("lang", "source", "term", "n", "first"), "kept")
    per_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.count_if("first").alias("terms"))
    sized = groups.join(per_group, ["lang", "source"], "left").fillna(0, ["group_n", "terms"])
    whole = Window.partitionBy("lang")
    heads = scratch.store(sized.select("lang", "source", "group_n", F.sum("group_n").over(whole).alias("lang_n"), F.sum("terms").over(whole).alias("kept")), "heads")
    shards = max(1, -(-kept.count() // shard_rows))
    none = F.lit(None)
    dealt = kept.select("lang", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard"), "source", "term", "n", *[none.cast("bigint").alias(c) for c in ("group_n", "lang_n", "kept")])
    everywhere = heads.select("lang", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "source", none.cast("string").alias("term"), none.cast("bigint").alias("n"), "group_n", "lang_n", "kept")
    form = "lang string, source string, part string, item string, value bigint"
    parts = scratch.store(dealt.unionByName(everywhere).groupBy("lang", "shard").applyInArrow(lambda table: _shard(table, top), form), "parts")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    pairs = parts.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", rank)
    # The filter on the rank alone lets every task keep its best rows of a group before they meet.
    terms = parts.filter("part = 'term'").withColumn("rank", rank).filter(F.col("rank") <= top)
    return pairs.unionByName(terms)
