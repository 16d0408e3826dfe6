from pyspark.sql import functions as F

from quillset.operators import dedup
from quillset.operators.chunking import chunk_documents
from quillset.streaming import ingest, progress

EVENTS = "run_id string, seq bigint, done bigint, total bigint, total_items bigint"


def test_progress_stream_equals_batch(spark, tmp_path):
    df = spark.range(500).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 20)).alias("run_id"),
        F.col("id").alias("seq"), F.col("id").alias("done"), F.lit(500).cast("bigint").alias("total"), (F.col("id") * 2).alias("total_items"),
    )
    df.repartition(5).write.parquet(f"{tmp_path}/in")
    stream = progress.latest_progress(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(spark.table("latest").collect()) == sorted(progress.latest_progress(df).collect())
    log = progress.append_events(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in"), f"{tmp_path}/log", f"{tmp_path}/cp")
    log.awaitTermination()
    assert spark.read.json(f"{tmp_path}/log").count() == 500


def test_documents_are_processed_once_across_restarts(spark, tmp_path):
    schema = "k string, text string"
    docs = lambda *rows: spark.createDataFrame(list(rows), schema).write.mode("append").parquet(f"{tmp_path}/docs")
    docs(("a", "# one\nx"), ("b", "plain"))
    start = lambda: ingest.process_documents(
        spark.readStream.schema(schema).parquet(f"{tmp_path}/docs"), lambda batch: chunk_documents(batch, "k"), f"{tmp_path}/out", f"{tmp_path}/cp"
    )
    start().awaitTermination()
    docs(("c", "# two\ny\n# three\nz"))
    start().awaitTermination()
    start().awaitTermination()
    got = ingest.read_batches(spark, f"{tmp_path}/out")
    want = chunk_documents(spark.read.parquet(f"{tmp_path}/docs"), "k")
    assert sorted(got.select("k", "chunk_id", "text").collect()) == sorted(want.select("k", "chunk_id", "text").collect())


def test_items_are_compared_with_everything_kept_before(spark, tmp_path):
    schema = "k string, instruction string"
    put = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/items")
    start = lambda: ingest.keep_new_items(
        spark.readStream.schema(schema).parquet(f"{tmp_path}/items"), f"{tmp_path}/kept", f"{tmp_path}/cp", "k"
    ).awaitTermination()
    put(("s", "what is the limit"), ("s", "what is the limit"), ("t", "other"))
    start()
    put(("s", "What is the limit?"), ("t", "what is the limit"), ("s", "entirely new words"))
    start()
    got = sorted((r["k"], r["instruction"]) for r in ingest.read_batches(spark, f"{tmp_path}/kept").collect())
    assert got == sorted([("s", "what is the limit")] * 2 + [("t", "other"), ("t", "what is the limit"), ("s", "entirely new words")])
    assert dedup.ROUND_THRESHOLD == 0.9
