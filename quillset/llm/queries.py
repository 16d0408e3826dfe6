"""The registered queries of this folder, each over its whole table, and their DuckDB statements where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillset.llm import clusters, divergence, embedding_dedup, exact_dedup, line_dedup, near_dedup, packing, pieces, repeats, secrets, sharding, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.without_boilerplate(_read(spark, sf_dir, "documents"), site="source", sites=10)
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.archived_captures(_read(spark, sf_dir, "pages"))
    return captures.select(
        "page_id", F.col("capture.response.payload_bytes"), F.col("capture.response.payload_digest"), F.col("capture.response.record_type"),
        F.col("refers_to"), F.col("capture.request.method").alias("method"), F.col("capture.metadata.charset").alias("charset"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    scored = toxicity.score_documents(docs, toxicity.learn_lexicon(docs, labels))
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "n_hits")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), buckets=16, budget=65536)


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(_read(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_digests(_read(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_read(spark, sf_dir, "embeddings"), threshold=0.95)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents"), shards=24, slots=4096)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_read(spark, sf_dir, "documents")).drop("rid")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergences(_read(spark, sf_dir, "documents"))


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.without_repeats(_read(spark, sf_dir, "documents"), length=200)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = clusters.cluster_vectors(_read(spark, sf_dir, "embeddings"))
    return placed.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join("centroid", ",").cast("binary"), 256).alias("centroid_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_warc, op3_toxicity, op4_near_dedup, op5_packing, op6_pieces, op7_secrets, op8_embedding_dedup, op9_sharding, op10_exact_dedup, op11_source_divergence, op12_repeats, op13_clusters)
}

def _cluster_sql(rounds: int) -> str:
    """The rounds unrolled: assignments a0, a1, ... under centroids c0, c1, ..."""
    near = """(SELECT rid, c AS cluster, distance FROM (SELECT rid, c, list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(v, m)])::BIGINT AS distance FROM points, c{k})
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, c) = 1)"""
    parts = [
        """points AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64)""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v AS m FROM points QUALIFY c < 8)",
    ]
    for k in range(rounds):
        parts.append(f"a{k} AS MATERIALIZED {near.format(k=k)}")
        parts.append(f"""c{k + 1} AS MATERIALIZED (SELECT c, coalesce(moved, m) AS m FROM c{k} LEFT JOIN (
  SELECT cluster, list(CASE WHEN s < 0 THEN -((n - 1 - s) // n) ELSE s // n END ORDER BY d) AS moved FROM (
    SELECT cluster, d, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(range(64)) AS d, unnest(v) AS x FROM a{k} JOIN points USING (rid)) GROUP BY cluster, d) GROUP BY cluster) ON c = cluster)""")
    parts.append(f"placed AS {near.format(k=rounds)}")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, cluster::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256 FROM placed JOIN points USING (rid) JOIN c{rounds} ON c = cluster"""


ORACLES: dict[str, str] = {
    "op1_line_dedup": r"""
WITH texts AS (SELECT doc_id, coalesce(source, chr(0)) AS site, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, string_split(text, chr(10)) AS lines, row_number() OVER () AS rid FROM texts),
each AS (
  SELECT rid, site, unnest(range(len(lines))) AS pos, trim(unnest(lines), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM split
),
wide AS (SELECT line FROM each WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 10),
gone AS (SELECT rid, list(pos) AS positions FROM each SEMI JOIN wide USING (line) GROUP BY rid)
SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(lines) END AS n_lines, coalesce(len(positions), 0) AS n_removed,
  sha256(CASE WHEN positions IS NULL THEN text
    ELSE coalesce(array_to_string([lines[i + 1] for i in range(len(lines)) if NOT list_contains(positions, i)], chr(10)), '') END) AS text_sha256
FROM split LEFT JOIN gone USING (rid)""",
    "op10_exact_dedup": r"""
WITH texts AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
groups AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM texts JOIN groups USING (norm)""",
    "op11_source_divergence": r"""
WITH texts AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
each AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM texts),
kept AS (SELECT lang, term FROM each GROUP BY ALL HAVING count(DISTINCT rid) >= 3),
counts AS (SELECT lang, source, term, count(*) AS n FROM each SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM texts)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL) USING (lang, source) LEFT JOIN sizes USING (lang)),
filled AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (total + v) AS p
  FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
usual AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (any_value(l.total) + any_value(v)) AS q
  FROM counts JOIN (SELECT lang, sum(n) AS total FROM counts GROUP BY lang) AS l USING (lang) JOIN sizes USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM filled AS x JOIN filled AS y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) AS s
  ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM filled JOIN usual USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200""",
    "op12_repeats": r"""
WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
bytes AS MATERIALIZED (SELECT rid, unnest(range(1, octet_length(b) + 1)) AS i, b FROM texts),
windows AS MATERIALIZED (SELECT rid, i, md5_number(array_slice(b, i, i + 199)) AS w FROM bytes WHERE i + 199 <= octet_length(b)),
starts AS (SELECT rid, i FROM windows SEMI JOIN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1) USING (w)),
marked AS (SELECT b.rid, b.i, b.b, coalesce(max(s.i) OVER (PARTITION BY b.rid ORDER BY b.i) > b.i - 200, FALSE) AS gone FROM bytes AS b LEFT JOIN starts AS s ON b.rid = s.rid AND b.i = s.i),
runs AS (SELECT *, coalesce(lag(gone) OVER (PARTITION BY rid ORDER BY i), FALSE) AS before FROM marked),
cut AS (SELECT rid, count_if(gone) AS n_removed, count_if(gone AND NOT before) AS n_spans, string_agg(CASE WHEN gone THEN '' ELSE hex(array_slice(b, i, i)) END, '' ORDER BY i) AS kept FROM runs GROUP BY rid)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM texts LEFT JOIN cut USING (rid)""",
    "op13_clusters": _cluster_sql(10),
}
