"""Near-duplicates by a chosen-path set similarity join: trees branch documents recursively by selected minwise tokens, small nodes are
compared exhaustively, and independent trees are repeated to reach the target recall (Christiani, Pagh and Sivertsen, 2018).

A document's set holds the hashes (64 bits) of its distinct five-word shingles. Each tree sends a set down one path, sometimes two: the node reached so
far selects the coordinate whose minwise token chooses the next node. Two sets of similarity s stay together on a step with
probability s, so few unrelated sets share a node after some steps, while near copies do.

Copies are folded first (one class per distinct set). A node of at most ``node_size`` classes is compared in full; a larger one is first linked in a
star to the member that agrees most with the node's most frequent tokens, then branched on unless nearly all its members look linked to that one
or the last step kept nearly all of them (near copies stay together on every further step, so branching would not part them). Large nodes that are not branched on and, links confirmed, are
not one component are compared in blocks, each member with those of other components, so nothing is capped. In blocks, members bring the
1,024 smallest hashes of their sets, which is the whole set of most documents, so hardly a pair leaves a block that is no link. Estimates only
choose what to compare: every link is confirmed on full sets.

Defined results: fewer than five words make one shingle of all of them; null and empty texts have no set (0 shingles) and link with nothing;
rows with one doc_id count as one vertex, whose links are those of all its texts; a null doc_id links with nothing, has no component and is kept; no rows give no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillset.llm.shared import Scratch, components, own_columns
from quillset.session import BATCH_ROWS

WORDS, COORDINATES, TABLE_WORDS, SKETCH = 5, 64, 300_000, 1024
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _multipliers() -> np.ndarray:
    return np.random.default_rng(20_181_001).integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """Word -> 64-bit hash; emptied when full, so memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= TABLE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a UTF-8 text; only A-Z are lowered, words end at ASCII white space."""
    words = np.array(list(map(hashes.__getitem__, text.lower().split())), dtype=np.uint64)
    if not len(words):
        return words
    size = max(1, len(words) - WORDS + 1)
    out = np.zeros(size, dtype=np.uint64)
    for k in range(min(WORDS, len(words))):
        out = (out + words[k : k + size]) * MULTIPLY
        out ^= out >> np.uint64(31)
    # The number of words tells a short text's one shingle from a longer text's.
    out = (out + np.uint64(min(WORDS, len(words)))) * MULTIPLY
    return np.unique(out ^ (out >> np.uint64(29)))


def _texts(docs: DataFrame) -> DataFrame:
    return own_columns(docs, doc_id="doc_id", text="text").selectExpr("cast(doc_id as bigint) doc_id", "text", "xxhash64(text) h")


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, two integers that identify the set, and its minwise tokens (one per coordinate)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes, multipliers = WordHashes(), _multipliers()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t or b"", hashes) for t in part.column("text").cast(pa.binary()).to_pylist()]
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(sizes)
                tokens = np.zeros((len(sets), COORDINATES), dtype=np.int32)
                if len(full):
                    flat, starts = np.concatenate([sets[i] for i in full]), np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    for c, m in enumerate(multipliers):
                        tokens[full, c] = (np.minimum.reduceat(flat * m, starts) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                keys = np.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], dtype="S16")
                pair = np.frombuffer(b"".join(k.ljust(16, b"\0") for k in keys.tolist()), dtype=np.int64).reshape(-1, 2)
                lists = pa.ListArray.from_arrays(np.arange(0, tokens.size + 1, COORDINATES, dtype=np.int32), pa.array(tokens.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(sizes), pa.array(pair[:, 0]), pa.array(pair[:, 1]), lists], names=["doc_id", "h", "n_shingles", "k1", "k2", "tokens"])

    return _texts(docs).mapInArrow(work, "doc_id bigint, h bigint, n_shingles bigint, k1 bigint, k2 bigint, tokens array<int>")


def _children(node: Column, tokens: Column, extra: float) -> Column:
    """The nodes that follow: the node itself selects one coordinate, and a second one with probability ``extra``."""
    pick = lambda name: F.pmod(F.xxhash64(node, F.lit(name)), F.lit(COORDINATES)).cast("int")
    step = lambda name: F.xxhash64(node, F.lit(name), F.element_at(tokens, pick(name) + 1))
    second = F.pmod(F.xxhash64(node, F.lit("branch")), F.lit(1000)) < int(extra * 1000)
    return F.when(second, F.array(step("first"), step("second"))).otherwise(F.array(step("first")))


def _compare(groups: DataFrame, percent: int, least: float) -> DataFrame:
    """a < b, estimate for the pairs of members of each row's list whose sizes allow ``percent`` and whose similarity, estimated from minwise
    tokens, reaches ``least``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members in batch.column("members"):
                values = members.as_py()
                ids, sizes = (np.array([v[name] for v in values]) for name in ("id", "n"))
                tokens = np.array([v["tokens"] for v in values], dtype=np.int32).reshape(-1, COORDINATES)
                out: list[tuple] = []
                for i in range(len(ids)):
                    near = np.flatnonzero((ids > ids[i]) & (100 * np.minimum(sizes[i], sizes) >= percent * np.maximum(sizes[i], sizes)))
                    if len(near):
                        same = (tokens[near] == tokens[i]).mean(axis=1)
                        out += [(ids[i], ids[j], s) for j, s in zip(near.tolist(), same.tolist(), strict=True) if s >= least]
                if out:
                    a, b, s = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["a", "b", "estimate"])

    return groups.select("members").mapInArrow(work, "a bigint, b bigint, estimate double")


def _sketches(sets: DataFrame) -> DataFrame:
    """rep, sketch: the ``SKETCH`` smallest hashes (32 bits, ascending, as bytes) of each set, the whole of it if it holds no more."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mixed = [(np.frombuffer(s.as_py(), dtype=np.uint64) * MULTIPLY) >> np.uint64(32) for s in batch.column("set")]
            out = [np.unique(m.astype(np.uint32))[:SKETCH].tobytes() for m in mixed]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], names=["rep", "sketch"])

    return sets.select("id", "set").mapInArrow(work, "rep bigint, sketch binary")


def _compare_blocks(pairs: DataFrame, percent: int) -> DataFrame:
    """a < b for the pairs of each row's two lists (members, others) that may reach ``percent`` by their sketches and are apart in components.

    Lists hold at most a block of (id, root, n, sketch) each; with others null, members are compared among themselves. The similarity is
    that of the two sets below the lower of the sketches' ends: exact for whole sets, else from 1,024 or more hashes, with a
    deviation of 1.2 points, of which four are allowed.
    """

    def load(values: list) -> tuple:
        ids, roots, sizes = (np.array([v[name] for v in values]) for name in ("id", "root", "n"))
        return ids, roots, sizes, [np.frombuffer(v["sketch"], dtype=np.uint32) for v in values]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mine, yours in zip(batch.column("members"), batch.column("others"), strict=True):
                own = not yours.is_valid
                ids, roots, sizes, sketches = left = load(mine.as_py())
                ids2, roots2, sizes2, sketches2 = left if own else load(yours.as_py())
                # Ranks keep the hashes' order, so a table over them tells what two sketches share.
                ranks, flat = np.unique(np.concatenate([*sketches, *sketches2]), return_inverse=True)
                lengths, lengths2 = (np.array([len(x) for x in part]) for part in (sketches, sketches2))
                starts = np.concatenate([[0], np.cumsum(lengths)])
                flat, flat2 = flat[: starts[-1]], flat[starts[-1] :]
                starts2 = np.concatenate([[0], np.cumsum(lengths2)[:-1]])
                ends2 = np.where(lengths2 < SKETCH, len(ranks), flat2[starts2 + lengths2 - 1])
                marked, a, b = np.zeros(len(ranks), dtype=bool), [], []
                for i in range(len(ids)):
                    apart = (roots2 != roots[i]) & (100 * np.minimum(sizes[i], sizes2) >= percent * np.maximum(sizes[i], sizes2))
                    apart &= (ids2 > ids[i]) | (not own)
                    if not apart.any():
                        continue
                    these = flat[starts[i] : starts[i + 1]]
                    marked[these] = True
                    shared = np.add.reduceat(marked[flat2], starts2, dtype=np.int64)
                    marked[these] = False
                    end = np.minimum(ends2, len(ranks) if len(these) < SKETCH else these[-1])
                    here = np.searchsorted(these, end, side="right")
                    there = lengths2 if (end == len(ranks)).all() else np.add.reduceat(flat2 <= np.repeat(end, lengths2), starts2, dtype=np.int64)
                    bound = np.where(end == len(ranks), percent - 0.5, percent - 5)
                    found = ids2[apart & (100 * shared >= bound * (here + there - shared))]
                    a += np.minimum(found, ids[i]).tolist()
                    b += np.maximum(found, ids[i]).tolist()
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return pairs.select("members", "others").mapInArrow(work, "a bigint, b bigint")


def _stars(large: DataFrame, reps: DataFrame, sample_size: int, percent: int, least: float) -> DataFrame:
    """node, a, b, estimate: every member of each large node with the member that agrees most with the node's most frequent tokens.

    The most frequent tokens come from a sample of about ``sample_size`` members dealt by hash; the agreement is taken over all members. Both
    are aggregated before anything is joined back; of the agreement each task sends one row per node.
    """
    large = large.join(reps, "rep")
    chance = F.pmod(F.xxhash64("rep", "node"), F.lit(1_000_000)) * F.col("size") < F.lit(sample_size * 1_000_000)

    def usual(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column("sample"):
                tokens = np.array(value.as_py(), dtype=np.int32)
                pairs = [np.unique(column, return_counts=True) for column in tokens.T]
                out.append([int(v[c.argmax()]) for v, c in pairs])
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.list_(pa.int32()))], names=["node", "usual"])

    samples = large.filter(chance).groupBy("node").agg(F.collect_list("tokens").alias("sample"))
    modes = samples.mapInArrow(usual, "node bigint, usual array<int>")
    agreement = F.aggregate(F.arrays_zip("tokens", "usual"), F.lit(0), lambda n, p: n + (p["tokens"] == p["usual"]).cast("int"))
    judged = large.join(modes, "node").select("node", F.struct(agreement.alias("agree"), F.col("rep").alias("id"), F.col("n"), "tokens").alias("best"))
    centres = judged.groupBy("node").agg(F.max("best").alias("centre"))
    joined = large.join(centres, "node").filter(F.col("rep") != F.col("centre.id"))
    same = F.aggregate(F.arrays_zip("tokens", F.col("centre.tokens").alias("other")), F.lit(0), lambda n, p: n + (p["tokens"] == p["other"]).cast("int")) / COORDINATES
    close = 100 * F.least("n", "centre.n") >= percent * F.greatest("n", "centre.n")
    pairs = joined.filter(close).select("node", F.least("rep", "centre.id").alias("a"), F.greatest("rep", "centre.id").alias("b"), same.alias("estimate"))
    return pairs.filter(F.col("estimate") >= least)


def _sets(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """id, set (64-bit hashes as bytes) of the classes in ``heads`` (rep, doc_id, h), each read from the row that heads it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t or b"", hashes) for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "set"])

    # Always by shuffle: how many texts are needed grows with the corpus, so their ids have no size bound to broadcast on.
    needed = heads.select("rep", "doc_id", "h").hint("merge")
    # Repeated rows go while the join has them in one place: that takes no shuffle of the sets.
    once = _texts(docs).join(needed, ["doc_id", "h"]).dropDuplicates(["doc_id", "h", "rep"])
    return once.select("rep", "text").mapInArrow(work, "id bigint, set binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), each given once, with 100 * intersection >= percent * union on full sets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    left, right = sets.select(F.col("id").alias("a"), F.col("set").alias("x")), sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").mapInArrow(work, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, percent: int = 85, trees: int = 16, node_size: int = 20, levels: int = 6, least: float | None = None, linked: float | None = None, covered: float = 0.9, together: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    ``least``: estimated similarity (over 64 tokens) from which a pair is compared in full, by default four deviations of the estimate below
    ``percent`` (0.67 at 85 %, 0.60 at 80 %). ``linked`` (default 2.25 deviations below; 0.75 and 0.69): a large node of which ``covered`` of the members reach it with their centre is not branched on,
    nor one that kept ``together`` of its parent's members: a step keeps about the mean similarity of a node's members, so further ones would part little.
    """
    deviation = (percent / 100 * (1 - percent / 100) / COORDINATES) ** 0.5
    least = percent / 100 - 4 * deviation if least is None else least
    linked = percent / 100 - 2.25 * deviation if linked is None else linked
    scratch = Scratch(docs.sparkSession, "near", BATCH_ROWS)
    store = scratch.store
    rows = store(signatures(docs), "rows")
    usable = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # A class is a distinct set; ids of classes are their own, since one doc_id may head several.
    folded = usable.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "h", F.col("n_shingles").alias("n"), "tokens")).alias("head"))
    classes = store(folded.select("k1", "k2", F.monotonically_increasing_id().alias("rep"), F.col("head.doc_id").alias("first"), "head.h", "head.n", "head.tokens"), "classes")
    reps = classes.select("rep", F.col("first").alias("doc_id"), "h", "n", "tokens")
    tokens = reps.select("rep", "n", "tokens")

    first = F.array(*[F.xxhash64(F.lit(t), F.element_at("tokens", t * COORDINATES // trees + 1)) for t in range(trees)])
    frontier = tokens.select("rep", F.lit(None).cast("bigint").alias("parent"), F.explode(first).alias("node"))
    small, stars, ends = [], [], []
    for level in range(1, levels + 1):
        # Every step is a shuffle of all partitions, however small its rows: a node's size and parent are taken with its count, and nodes to be
        # compared as they are and larger ones are told apart before members are joined.
        met = frontier.groupBy("node").agg(F.count("*").alias("size"), F.first("parent").alias("parent")).filter("size > 1")
        sizes = store(met, f"sizes-{level}")
        fits = frontier.join(sizes.filter(F.col("size") <= node_size).select("node"), "node").groupBy("node").agg(F.sort_array(F.collect_list("rep")).alias("ids"))
        small.append(store(fits.select("ids"), f"small-{level}"))
        big = store(sizes.filter(F.col("size") > node_size), f"big-{level}")
        if big.limit(1).count() == 0:
            break
        larger = store(frontier.select("node", "rep").join(big.select("node", "size"), "node"), f"larger-{level}")
        stars.append(store(_stars(larger, tokens, 64, percent, least), f"stars-{level}"))
        # Decided per node: branched on, or compared as it is.
        linked_in = stars[-1].filter(F.col("estimate") >= linked).groupBy("node").agg(F.count("*").alias("linked"))
        alike = (F.coalesce("linked", F.lit(0)) + 1 >= covered * F.col("size")) | (F.col("size") >= together * F.coalesce("parent", F.lit(2**62)))
        nodes = store(big.join(linked_in, "node", "left").select("node", (alike | F.lit(level == levels)).alias("whole")), f"decided-{level}")
        # One join for both: what stays as it is and what goes on.
        told = store(larger.join(nodes, "node").select("node", "size", "rep", "whole"), f"ends-{level}")
        ends.append(told.filter("whole").drop("whole"))
        step = 1 / (percent / 100) - 1
        onward = told.filter("NOT whole").join(tokens, "rep")
        frontier = store(onward.select("rep", F.col("size").alias("parent"), F.explode(_children(F.col("node"), F.col("tokens"), step)).alias("node")), f"frontier-{level}")
        scratch.forget(*[f"{name}-{level}" for name in ("sizes", "big", "larger", "decided")], f"frontier-{level - 1}")
        scratch.settle(1, 0.3)

    # The same members meet in many trees: each distinct node is compared once.
    nodes = small[0]
    for more in small[1:]:
        nodes = nodes.unionAll(more)
    nodes = store(nodes.distinct().select(F.monotonically_increasing_id().alias("nid"), "ids"), "nodes")
    members = nodes.select("nid", F.explode("ids").alias("rep")).join(tokens, "rep")
    groups = members.groupBy("nid").agg(F.collect_list(F.struct(F.col("rep").alias("id"), "n", "tokens")).alias("members"))
    near = store(_compare(groups, percent, least).distinct(), "near")

    both = near.select("a", "b", "estimate").unionAll(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "estimate"))
    nearest = both.groupBy("a").agg(F.max_by("b", F.struct("estimate", "b")).alias("b"))
    begin = nearest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for star in stars:
        begin = begin.unionAll(star.select("a", "b"))
    begin = store(begin.distinct(), "begin")
    scratch.forget("nodes", *[f"{name}-{k}" for k in range(1, levels + 1) for name in ("small", "stars", "sizes", "big", "frontier")])
    scratch.settle(1, 0.3)
    named = begin.select("a").unionAll(near.select("a")).unionAll(begin.select("b")).unionAll(near.select("b")).distinct().withColumnRenamed("a", "rep")
    sets = store(_sets(docs, reps.join(named.hint("merge"), "rep", "left_semi")), "sets")
    links = store(_confirmed(begin, sets, percent), "links-1")
    scratch.settle(1, 0.3)

    # Pairs whose ends are one component already need no comparison; all others get one.
    known = components(scratch, links, "first", roots=False).withColumnRenamed("vertex", "rep")
    apart = _apart(near.select("a", "b").join(begin, ["a", "b"], "left_anti"), known)
    if ends:
        large = ends[0]
        for more in ends[1:]:
            large = large.unionAll(more)
        split = large.join(known, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
        # Nodes of one component need nothing more, and of nodes with the same members (a large group meets in many trees) one is compared.
        own, other = (F.sum(F.xxhash64("rep", F.lit(seed)).cast("decimal(20,0)")) for seed in (1, 2))
        rest = split.groupBy("node").agg(F.first("size").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"), own.alias("own"), other.alias("other")).filter("low < high")
        split = store(split.join(rest.groupBy("size", "own", "other").agg(F.min("node").alias("node")).select("node"), "node", "left_semi"), "split")
        missing = reps.join(split.select("rep").distinct().hint("merge"), "rep", "left_semi").join(sets.select(F.col("id").alias("rep")).hint("merge"), "rep", "left_anti")
        sets = sets.unionAll(store(_sets(docs, missing), "sets-2"))
        found = store(_blocks(scratch, split.join(reps.select("rep", "n"), "rep"), store(_sketches(sets), "sketches"), percent), "rest")
        apart = apart.unionAll(found).distinct()
        scratch.settle(1, 0.3)
    more = store(_confirmed(apart, sets, percent), "links-2")
    scratch.forget("sets", "sets-2", "sketches", "split", "dealt", "near", "begin", *[f"ends-{k}" for k in range(1, levels + 1)])
    scratch.settle(1, 0.3)

    # Documents are the vertices in the end: a class stands for its smallest doc_id, and a doc_id with several sets joins theirs.
    smallest = classes.select("rep", "first")
    pairs = links.select("a", "b").unionAll(more.select("a", "b"))
    ends_at = pairs.join(smallest.select(F.col("rep").alias("a"), F.col("first").alias("da")), "a").join(smallest.select(F.col("rep").alias("b"), F.col("first").alias("db")), "b")
    edges = ends_at.select(F.col("da").alias("a"), F.col("db").alias("b"))
    placed = rows.select("doc_id", "n_shingles", "k1", "k2").join(classes.select("k1", "k2", "first"), ["k1", "k2"], "left")
    repeated = usable.groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("low"), F.max(F.struct("k1", "k2")).alias("high")).filter("low <> high").select("doc_id")
    several = placed.filter("n_shingles > 0").join(repeated, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    known = components(scratch, edges.unionAll(several), "second", roots=False).withColumnRenamed("vertex", "first")
    none = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    placed = placed.withColumn("first", F.when(none, F.col("doc_id")).otherwise(F.coalesce("first", "doc_id")))
    out = placed.join(known, "first", "left").withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("root", "first")))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"))


def _apart(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs whose ends are not known to be one component; ends that ``known`` lacks are roots."""
    roots = known.select("rep", "root")
    left = pairs.join(roots.select(F.col("rep").alias("a"), F.col("root").alias("ra")), "a", "left")
    right = left.join(roots.select(F.col("rep").alias("b"), F.col("root").alias("rb")), "b", "left")
    return right.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def _blocks(scratch: Scratch, members: DataFrame, sketches: DataFrame, percent: int, block: int = 256) -> DataFrame:
    """Pairs near by their sketches and apart in components in large nodes, compared block by block; a pair that meets in several comes as often.

    Members of a node's largest component need no comparison with each other: they and the rest are dealt to blocks of their own, and only blocks of
    the rest are copied, to each other and to the blocks of the component. A task compares two blocks at a time.
    """
    item = F.struct(F.col("rep").alias("id"), "root", "n", "sketch")
    counts = members.groupBy("node", "root").agg(F.count("*").alias("count"))
    largest = counts.groupBy("node").agg(F.max_by("root", F.struct("count", "root")).alias("major"), F.max("count").alias("in_major"), F.sum("count").alias("all"))
    sized = members.join(largest, "node").withColumn("rest", F.col("root") != F.col("major"))
    majors = F.ceil(F.col("in_major") / block).cast("bigint")
    blocks = F.when(F.col("rest"), F.ceil((F.col("all") - F.col("in_major")) / block)).otherwise(majors).cast("bigint")
    numbered = sized.withColumns({"block": F.pmod(F.xxhash64("rep"), blocks), "majors": majors})
    dealt = scratch.store(numbered.join(sketches, "rep").groupBy("node", "rest", "block").agg(F.collect_list(item).alias("members"), F.first("majors").alias("majors")), "dealt")
    outside = dealt.filter("rest")
    to_major = outside.select("node", F.lit(False).alias("rest"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("majors") - 1)).alias("block"), F.lit(False).alias("own"), F.col("members").alias("others"))
    to_rest = outside.select("node", F.lit(True).alias("rest"), F.col("block").alias("to"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("block"))).alias("block"), F.col("members").alias("others"))
    to_rest = to_rest.select("node", "rest", "block", (F.col("to") == F.col("block")).alias("own"), "others")
    paired = dealt.select("node", "rest", "block", "members").join(to_major.unionByName(to_rest), ["node", "rest", "block"])
    return _compare_blocks(paired.select("members", F.when(~F.col("own"), F.col("others")).alias("others")), percent)
