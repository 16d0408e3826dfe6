"""Archives are written, read back and assembled; vector links are held to brute force; components; the pipeline end to end."""

import base64
import gzip
import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from quillset.llm import embedding_dedup, warc
from quillset.llm.shared import Scratch, components

PAGES = [
    (1, "http://a.org/x y", "same"), (5, "http://b.org/", "same"), (3, None, "same"), (4, "http://c.org", None), (2, "http://c.org", ""),
    (6, "http://d.org", "has\r\n\r\nWARC/1.1\r\nin it é"), (7, "http://e.org", "z" * 100_000), (7, "http://e.org", "z" * 100_000), (None, "http://f.org", "alone"),
]


def test_archives(spark):
    pages = spark.createDataFrame([(*p, "x", 3) for p in PAGES], "page_id long, url string, html string, digest string, salt int")
    rows = warc.archived_captures(pages, keep_payload=True, captures_per_file=2).collect()
    assert len(rows) == len(PAGES)
    kinds = sorted((r.page_id or -1, r.capture.response.record_type, r.refers_to) for r in rows)
    assert [k for k in kinds if k[0] != 7] == [(-1, "response", None), (1, "revisit", 5), (2, "revisit", 4), (3, "revisit", 5), (4, "response", None), (5, "response", None), (6, "response", None)]
    assert sorted((k[1], k[2]) for k in kinds if k[0] == 7) == [("response", None), ("revisit", 7)]
    texts = {p[0]: (p[2] or "").encode() for p in PAGES}
    for r in rows:
        response, payload = r.capture.response, texts[r.page_id]
        assert (response.payload_bytes, response.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert response.record_type == "revisit" or response.payload == payload
        assert r.capture.request.method == "GET" and r.capture.metadata.charset == "utf-8"
    assert warc.archived_captures(pages.filter("false")).count() == 0


def test_archives_of_several_members_and_missing_parts(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Type: application/http\r\nContent-Length: 21\r\n\r\nHTTP/1.1 200 OK\r\n\r\nhi\r\n\r\n"
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(record))
    records = warc.read_records(spark, str(tmp_path), keep_payload=True)
    assert records.count() == 2
    got = warc.assemble(records).first()
    assert got.capture.request is None and bytes(got.capture.response.payload) == b"hi"


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    vectors = [v + 0.12 * rng.standard_normal(16) for v in base for _ in range(6)] + [base[0]] * 5
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    n = len(rows)
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 16), (n + 3, [None] * 16), (n + 4, [float("nan")] * 16), (None, rows[0][1]), (n + 5, [1.0, 2.0]), (n + 6, [2.0, 4.0])]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, rep string, n int")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(table).collect()}
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    assert [got[i].n_links for i in range(n)] == (near.sum(axis=1) - 1).tolist()
    root = list(range(n))
    for _ in range(n):
        root = [min(root[j] for j in np.flatnonzero(near[i])) for i in range(n)]
    assert [got[i].component_id for i in range(n)] == root and all(got[i].kept == (root[i] == i) for i in range(n))
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i in range(n, n + 5))
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, True)
    assert (got[n + 6].n_links, got[n + 6].component_id) == (1, n + 5)
    assert embedding_dedup.near_vectors(table.filter("false")).count() == 0


def test_vectors_with_a_large_common_component(spark):
    rng = np.random.default_rng(5)
    away = lambda n: (v := rng.standard_normal((n, 64))) / np.linalg.norm(v, axis=1)[:, None]
    base = away(3000) * 0.45 + np.eye(64)[0] * 0.893  # unrelated vectors have a cosine of about 0.8
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = away(3000)
    side -= np.einsum("ij,ij->i", side, base)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    vectors = np.concatenate([base, 0.955 * base + np.sqrt(1 - 0.955**2) * side])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    links = int((unit @ unit.T >= 0.95).sum()) - len(vectors)
    found = sum(r.n_links for r in embedding_dedup.near_vectors(table).collect())
    assert links >= 6000 and 0.99 * links <= found <= links


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(400, 400 + i) for i in range(200)]
    root = list(range(700))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = dict(map(tuple, components(Scratch(spark, "test"), spark.createDataFrame(edges, "a long, b long"), "c").collect()))
    linked = {v for e in edges for v in e if e[0] != e[1]}
    assert got == {v: find(v) for v in linked}


def test_pipeline(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = Scratch(spark, "test").store(stage(spark, docs, sf_dir), "stage")
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= before and (docs.columns == columns or name == "packing"), name
        seen.append(len(after))
    assert seen[2] == seen[3] == seen[4] > 0 and corpus_pipeline.run(spark, sf_dir).count() == seen[-1]
    kept = corpus_pipeline.drop_copies(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    assert kept.count() == kept.select(F.regexp_replace("text", "[\\x20\\x09-\\x0D]+", " ")).distinct().count()
