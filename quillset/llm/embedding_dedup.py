"""Near-duplicate vectors by iterative quantisation: a learned rotation gives balanced binary codes, multi-index Hamming tables retrieve
candidates, and the original vectors decide (Gong and Lazebnik, 2011; Norouzi et al., 2012).

Rotations are fitted on a bounded sample of ``sample_size`` vectors; all vectors are coded and compared. A table files a vector under some
bits of its code; the number of bits follows the number of vectors, so that a bucket of unrelated vectors stays small, and the
number of tables (and of rotations) follows from the target recall at the threshold, by the angles of the sample's vectors once centred. Buckets are compared block by block, whole;
a pair that shares several tables counts in the first only.

Equal vectors are folded first, and their copies count as links of each other. Defined results: vectors that are null, empty, zero or hold null or
non-finite components link with nothing; vectors of unequal length never link; a null ``vec_id`` links with nothing and is kept; rows
that repeat an id with the same vector count as copies; no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillset.llm.shared import Scratch, components, own_columns


def fit_rotations(sample: np.ndarray, mean: np.ndarray, count: int, rounds: int = 30, seed: int = 7) -> list[np.ndarray]:
    """``count`` projections: principal axes, rotated from different starts until codes fit the projected vectors."""
    centred = sample - mean
    axes = np.linalg.eigh(centred.T @ centred)[1].T[::-1]  # of the small square matrix: the sample's own would be rows x rows
    projected, rng, out = centred @ axes.T, np.random.default_rng(seed), []
    for _ in range(count):
        rotation = np.linalg.qr(rng.standard_normal((axes.shape[0],) * 2))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(projected @ rotation >= 0, 1.0, -1.0).T @ projected)
            rotation = (u @ v).T
        out.append(axes.T @ rotation)
    return out


def agreements(unit: np.ndarray, mean: np.ndarray, threshold: float, seed: int = 11) -> list[np.ndarray]:
    """Chance that a bit agrees, for sample vectors and companions at cosine ``threshold``: by centred angle, as the codes see it. Companions
    lie in random directions, and in those in which the sample's vectors differ."""
    rng, out = np.random.default_rng(seed), []
    for away in (rng.standard_normal(unit.shape), unit[rng.permutation(len(unit))] - unit[rng.permutation(len(unit))] + 1e-9 * rng.standard_normal(unit.shape)):
        away = away - np.einsum("ij,ij->i", away, unit)[:, None] * unit
        away /= np.maximum(np.linalg.norm(away, axis=1), 1e-300)[:, None]
        x, y = unit - mean, threshold * unit + math.sqrt(max(0.0, 1 - threshold**2)) * away - mean
        lengths = np.maximum(np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1), 1e-300)
        out.append(1 - np.arccos(np.clip(np.einsum("ij,ij->i", x, y) / lengths, -1, 1)) / math.pi)
    return out


def plan_tables(rows: int, dims: int, agree: list[np.ndarray], recall: float, bucket: int = 32) -> tuple[int, int, int]:
    """(bits per table, tables, rotations): about ``bucket`` unrelated vectors share a bucket, and the pairs whose bits agree as in any of
    ``agree`` miss every table with a mean probability under 1 - recall. Fewer bits, down to none (one bucket of all), are taken when
    the comparisons they add cost less than the tables they save."""
    most = min(dims, 62, max(6, int(math.log2(max(rows, 2) / bucket))))
    plans = []
    for bits in range(most + 1):
        misses = [1 - a**bits for a in agree]
        enough = lambda n: all((m**n).mean() < 1 - recall for m in misses)  # noqa: B023, E731
        limit = max(1, int((rows + bucket) / (bucket + rows / 2**bits)) + 1)  # more tables cost more than comparing all with all
        if enough(limit):
            low, high = 0, limit
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (low, middle) if enough(middle) else (middle, high)
            plans.append((high * (bucket + rows / 2**bits), -bits, high))
    _, bits, tables = min(plans)
    return -bits, tables, math.ceil(tables / max(1, dims // -bits)) if bits else 0


def _keys(vectors: np.ndarray, mean: np.ndarray, rotations: list[np.ndarray], bits: int, tables: int) -> np.ndarray:
    """One bucket number per vector and table."""
    if not bits:
        return np.zeros((len(vectors), 1), dtype=np.int64)
    weights, out = 1 << np.arange(bits, dtype=np.int64), []
    for rotation in rotations:
        code = (vectors - mean) @ rotation >= 0
        out += [code[:, at : at + bits] @ weights for at in range(0, code.shape[1] - bits + 1, bits)]
    return np.stack(out[:tables], axis=1)


def _linked(x: pd.DataFrame, y: pd.DataFrame, table: int, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two blocks whose cosine reaches the threshold and whose first common table is this one."""
    vx, vy = np.stack(x["unit"].to_numpy()), np.stack(y["unit"].to_numpy())
    i, j = np.nonzero(vx @ vy.T >= threshold - 1e-9)
    keep = i < j if same else np.ones(len(i), dtype=bool)
    i, j = i[keep], j[keep]
    kx, ky = np.stack(x["keys"].to_numpy()), np.stack(y["keys"].to_numpy())
    first = (kx[i] == ky[j]).argmax(axis=1) == table
    i, j = i[first], j[first]
    exact = np.einsum("ij,ij->i", vx[i], vy[j]) >= threshold
    return i[exact], j[exact]


def _forest(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges that span the links of a block pair: as many as vertices at most."""
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            parent[v] = v = parent[parent[v]]
        return v

    for a, b in zip(ids[i].tolist(), ids[j].tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(v, root(v)) for v in list(parent) if root(v) != v]


def near_vectors(rows: DataFrame, threshold: float = 0.95, recall: float = 0.995, sample_size: int = 8192, block: int = 512, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "vectors")
    raw = own_columns(rows, vec_id=vec_id, vector=embedding).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & sound, F.lit(False))
    # Adding zero makes both zeros equal.
    plain = F.transform("vector", lambda x: x + 0.0)
    every = scratch.store(raw.select("vec_id", F.when(usable, plain).alias("vector"), F.xxhash64(F.when(usable, plain)).alias("h")), "rows")
    used = every.filter("vector IS NOT NULL")
    classes = scratch.store(used.groupBy("h", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    lengths = [r[0] for r in classes.select(F.size("vector")).distinct().collect()]  # as many as vector lengths
    counts, edges = [], []
    for dims in lengths:
        part = classes.filter(F.size("vector") == dims)
        total = part.count()
        sample = np.array([r[0] for r in part.select("vector").orderBy(F.xxhash64("rep"), "rep").limit(sample_size).collect()])
        unit = sample / np.linalg.norm(sample, axis=1)[:, None]
        mean = unit.mean(axis=0)
        bits, tables, turns = plan_tables(total, dims, agreements(unit, mean, threshold), recall)
        rotations = fit_rotations(unit, mean, turns)
        links = scratch.store(_bucket_links(part, mean, rotations, bits, tables, threshold, block, scratch, dims), f"links-{dims}")
        counts.append(links.filter("n > 0").select("id", "n"))
        edges.append(links.filter("root IS NOT NULL").select(F.col("id").alias("a"), F.col("root").alias("b")))
    copied = classes.select("h", "vector", "rep", "copies")
    # Only the class a row belongs to is looked up, by the vector itself.
    placed = every.join(copied, ["h", "vector"], "left").select("vec_id", "rep", "copies")
    if counts:
        linked, joined = counts[0], edges[0]
        for more_counts, more_edges in zip(counts[1:], edges[1:], strict=True):
            linked, joined = linked.unionAll(more_counts), joined.unionAll(more_edges)
        sums = linked.groupBy(F.col("id").alias("rep")).agg(F.sum("n").alias("others"))
        roots = components(scratch, joined, "vectors").withColumnRenamed("vertex", "rep")
        placed = placed.join(sums, "rep", "left").join(roots, "rep", "left")
    else:
        placed = placed.withColumn("others", F.lit(0)).withColumn("root", F.lit(None).cast("bigint"))
    component = F.coalesce("root", "rep", "vec_id")
    return placed.select(
        "vec_id", (F.coalesce("others", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("bigint").alias("n_links"), component.alias("component_id"),
        (F.col("vec_id").isNull() | (F.col("vec_id") == component)).alias("kept"),
    )


def _bucket_links(part: DataFrame, mean: np.ndarray, rotations: list[np.ndarray], bits: int, tables: int, threshold: float, block: int, scratch: Scratch, dims: int) -> DataFrame:
    """id, n (copies of linked vectors found in one block pair), root (an edge of the block pair's spanning forest, or null)."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = np.stack(batch.column("vector").to_numpy(zero_copy_only=False))
            unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
            keys = _keys(unit, mean, rotations, bits, tables)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("copies"), pa.array(list(unit), pa.list_(pa.float64())), pa.array(list(keys), pa.list_(pa.int64()))], names=["id", "copies", "unit", "keys"]
            )

    coded = scratch.store(part.select("rep", "copies", "vector").mapInArrow(code, "id bigint, copies bigint, unit array<double>, keys array<bigint>"), f"coded-{dims}")
    filed = coded.select("id", F.posexplode("keys").alias("table", "key"))
    sizes = filed.groupBy("table", "key").agg(F.count("*").alias("size")).filter("size > 1")
    shared = filed.join(sizes, ["table", "key"])
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    # A member of block i meets every block j: the pair (i, j) with i <= j is one group of at most about two blocks.
    meets = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    dealt = shared.select("id", "table", "key", own.alias("own"), F.explode(meets).alias("m")).select("id", "table", "key", "own", "m.i", "m.j").join(coded, "id")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        table, i, j = (int(group[c].iloc[0]) for c in ("table", "i", "j"))
        x, y = (group, group) if i == j else (group[group["own"] == i], group[group["own"] == j])
        a, b = _linked(x, y, table, threshold, i == j) if len(x) and len(y) else (np.array([], int), np.array([], int))
        ids = np.concatenate([x["id"].to_numpy(), y["id"].to_numpy()])
        copies = np.concatenate([x["copies"].to_numpy(), y["copies"].to_numpy()])
        b = b + len(x)
        found = np.bincount(a, weights=copies[b], minlength=len(ids)) + np.bincount(b, weights=copies[a], minlength=len(ids)) if len(a) else np.zeros(len(ids))
        at = np.flatnonzero(found)
        edges = _forest(ids, a, b)
        return pd.DataFrame(
            {
                "id": np.concatenate([ids[at], np.array([e[0] for e in edges], dtype=np.int64)]).astype(np.int64),
                "n": np.concatenate([found[at].astype(np.int64), np.zeros(len(edges), dtype=np.int64)]),
                "root": pd.array([None] * len(at) + [e[1] for e in edges], dtype="Int64"),
            }
        )

    return dealt.groupBy("table", "key", "i", "j").applyInPandas(compare, "id bigint, n bigint, root bigint")
