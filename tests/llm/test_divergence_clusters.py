"""Divergences and clusters against brute force written from their definitions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillset.llm import clusters, divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def divergences(rows, min_docs, top):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(lower))) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        spread = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in spread.items() if n >= min_docs)
        counts = defaultdict(Counter)
        for _, source, terms in mine:
            counts[source].update(t for t in terms if t in set(kept))
        counts = {s: counts[s] for s in {d[1] for d in mine}}
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in counts.items()}
        total = sum(counts.values(), Counter())
        q = {t: 1 + 10**9 * (total[t] + 1) // (sum(total.values()) + len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


@pytest.mark.parametrize("shard_rows", [7, 50_000])
def test_divergences(spark, shard_rows, monkeypatch):
    rng = random.Random(5)
    words = ["Alpha", "alpha", "béta", "ÉTÉ", "été", "x", "the", "quick", "brown", "日本語", "a_b", "c3d", "zé"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), rng.choice(["en", "fr"]), rng.choice(["a", "b", "c", "é"])) for _ in range(60)]
    rows += [(None, "en", "empty"), ("", "en", None), ("only here", "xx", "one"), ("the the", None, None), ("  12 _ ", "yy", "s"), ("", "yy", "t")] + [("same the text", "en", "hot")] * 30
    rows += [("the " * 50_000, "fr", "long")]
    table = spark.createDataFrame([(*r, 1, "n", 2) for r in rows], "text string, lang string, source string, n long, term string, shard int")
    got = [tuple(r) for r in divergence.source_divergences(table.repartition(5), top=4, shard_rows=shard_rows).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == divergences(rows, 3, 4)
    assert divergence.source_divergences(table.filter("false")).count() == 0


def test_scaled_is_exact():
    counts, total = np.array([0, 1, 7, 10**17, 10**17 + 1]), 5 * 10**17 + 9
    assert divergence.scaled(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in counts]


def clustered(points, k, rounds):
    v = {i: [int(np.floor(1024 * x)) for x in p] for i, p in points}
    ids = sorted(v, key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())
    centres = [v[i] for i in ids[:k]]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        at = {i: nearest(x)[1] for i, x in v.items()}
        members = defaultdict(list)
        for i, j in at.items():
            members[j].append(v[i])
        centres = [[sum(col) // len(members[j]) for col in zip(*members[j], strict=True)] if members[j] else c for j, c in enumerate(centres)]
    out = {i: nearest(x)[::-1] for i, x in v.items()}
    inertia = Counter()
    for j, d in out.values():
        inertia[j] += d
    return {i: (j, d, inertia[j], sum(inertia.values()), centres[j]) for i, (j, d) in out.items()}


def test_clusters(spark):
    rng = np.random.default_rng(2)
    # Few distinct values: ties between centroids, and equal vectors, are frequent.
    points = [(i, rng.integers(-2, 3, 8) / 4) for i in range(150)] + [(i, rng.standard_normal(8) * 3 + 50) for i in range(150, 200)]
    rows = [(i, [float(x) for x in p]) for i, p in points]
    odd = [(900, None), (901, []), (902, [1.0] * 7), (903, [None] * 8), (904, [float("nan")] * 8), (905, [float("inf")] * 8), (906, [1e300] * 8)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "vec_id long, embedding array<double>, cluster string, v int").repartition(3)
    got = {r.vec_id: (r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid) for r in clusters.cluster_vectors(table, clusters=6, rounds=4, dims=8).collect()}
    assert got == clustered(points, 6, 4)
    assert clusters.cluster_vectors(table.filter("false"), dims=8).count() == 0
    few = clusters.cluster_vectors(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [5.0, 5.0])], "vec_id long, embedding array<double>"), dims=2).collect()
    assert sorted((r.vec_id or 0, r.cluster) for r in few) == [(0, 0), (1, 0), (1, 0)]
    alone = clusters.cluster_vectors(spark.createDataFrame([(None, [5.0, 5.0])], "vec_id long, embedding array<double>"), dims=2).first()
    assert (alone.vec_id, alone.distance, alone.centroid) == (None, 0, [5120, 5120])


def test_walk_stops_early_and_stays_exact():
    rng = np.random.default_rng(4)
    centroids, vectors = rng.integers(-50, 50, (12, 3)), rng.integers(-60, 60, (500, 3))
    at, distance = clusters.SortedCentroids(centroids).nearest(vectors)
    every = ((vectors[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert at.tolist() == every.argmin(axis=1).tolist() and distance.tolist() == every.min(axis=1).tolist()
