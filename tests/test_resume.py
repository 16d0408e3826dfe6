"""Runs cut off after a batch and started again: every chunk is asked once, and records equal those of an uninterrupted run."""

import json
import os
import uuid

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quillset.operators import generation, resume
from quillset.sources.files import with_document_columns


def documents(spark, n, parts=3):
    # All texts share their first 512 characters and length: 32-bit ids of names and heads would not tell them apart for sure, SHA-256 does.
    text = lambda i: "\n".join(f"# Part {k}\n" + "same head " * 60 + f"sentence {i:04d} of part {k}." for k in range(parts))
    df = spark.createDataFrame([(f"s{i}", "d.md", "md", text(i)) for i in range(n)], "session_id string, source_name string, file_type string, text string")
    return with_document_columns(df)


def counting(folder, down=""):
    """A generator that leaves a file per request, and fails for texts that hold ``down``."""

    def generator(batch):
        rows = []
        for user in batch["user"]:
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as log:
                log.write(user)
            sentence = user.rsplit("sentence", 1)[1].split(".")[0]
            if down and down in user:
                rows.append((None, None, None, None, "timeout"))
            else:
                rows.append((json.dumps({"items": [{"instruction": f"what of{sentence}", "input": "", "output": f"sentence{sentence}"}]}), "stop", 1, 1, None))
        return rows

    return generator


def asked(folder):
    return sorted(open(os.path.join(folder, f)).read() for f in os.listdir(folder))


def values(df):
    return sorted(tuple(r) for r in df.select("session_id", "source.chunk_id", "source.start_offset", "instruction", "output", "pos").collect())


@pytest.mark.parametrize("cut", [0, 2])
def test_cut_off_after_a_batch(spark, tmp_path, cut):
    docs = documents(spark, 6).repartition(4)
    calls, whole_calls, path = tmp_path / "calls", tmp_path / "whole", str(tmp_path / "run")
    calls.mkdir(), whole_calls.mkdir()

    def stop(batch_id):
        if batch_id == cut:
            raise KeyError("driver lost")

    with pytest.raises(StreamingQueryException):
        resume.run_in_batches(docs, counting(str(calls)), path, max_chars=1000, batch_chunks=3, files_per_batch=1, on_batch=stop)
    first = len(asked(calls))
    run = resume.run_in_batches(docs, counting(str(calls)), path, max_chars=1000, batch_chunks=3, files_per_batch=2)
    resume.run_in_batches(docs, counting(str(whole_calls)), str(tmp_path / "other"), max_chars=1000)
    assert 0 < first < len(asked(calls)) and asked(calls) == asked(whole_calls)
    got, want = (resume.stored_records(docs, p, max_chars=1000, created_at=F.lit(0)) for p in (path, str(tmp_path / "other")))
    assert values(got) == values(want) and len(values(got)) == 18
    kept = resume.finish_run(docs, path, run, max_chars=1000, created_at=F.lit(0))
    assert kept.count() <= 18
    seen = resume.read_events(spark, path).groupBy("status").count().collect()
    seen = {r["status"]: r["count"] for r in seen}
    assert seen == {"completed": 18, "resumed": first, "error": 6, "dedup": 6, "done": 6}
    # A further run has nothing to ask.
    resume.run_in_batches(docs, counting(str(calls)), path, max_chars=1000)
    assert len(asked(calls)) == 18


def test_half_written_batches_do_not_count(spark, tmp_path):
    docs, path = documents(spark, 2), str(tmp_path / "run")
    calls = tmp_path / "calls"
    calls.mkdir()
    resume.run_in_batches(docs.filter("session_id = 's0'"), counting(str(calls)), path, max_chars=1000)
    # Items of a batch whose markers were never written.
    stored = spark.read.parquet(f"{path}/items")
    stored.drop("batch").withColumn("session_id", F.lit("s1")).write.parquet(f"{path}/items/batch=000000000000001-aaaa-000001")
    stored.drop("batch").write.parquet(f"{path}/items/batch=000000000000001-aaaa-000002")
    resume.run_in_batches(docs, counting(str(calls)), path, max_chars=1000)
    assert resume.stored_records(docs, path, max_chars=1000).count() == 6
    assert {r["session_id"] for r in resume.stored_records(docs.filter("session_id = 's1'"), path, max_chars=1000).collect()} == {"s1"}
    # Other settings are another fingerprint: nothing stored fits.
    assert resume.completed_chunks(resume.run_chunks(docs, 2000), path).count() == 0


def test_failed_chunks_are_tried_again(spark, tmp_path):
    docs, path = documents(spark, 3), str(tmp_path / "run")
    calls = tmp_path / "calls"
    calls.mkdir()
    resume.run_in_batches(docs, counting(str(calls), down="0001 of part 2"), path, max_chars=1000)
    run = resume.stored_run(docs, path, max_chars=1000)
    assert [(r["session_id"], r["chunk_id"], r["message"], r["attempts"]) for r in run.failures.collect()] == [("s1", "chunk_003", "timeout", 3)]
    assert run.items.count() == 8
    resume.run_in_batches(docs, counting(str(calls)), path, max_chars=1000)
    run = resume.stored_run(docs, path, max_chars=1000)
    assert run.failures.count() == 0 and run.items.count() == 9 and len(asked(calls)) == 8 + 3 + 1
    query = resume.stream_events(spark, path).writeStream.format("memory").queryName("events_seen").trigger(availableNow=True).start()
    query.awaitTermination()
    streamed = sorted(map(str, spark.table("events_seen").select("run", "seq", "session_id", "status").collect()))
    assert streamed == sorted(map(str, resume.read_events(spark, path).select("run", "seq", "session_id", "status").collect()))
    order = resume.read_events(spark, path).filter("session_id = 's1' AND chunk_id = 'chunk_003'").orderBy("run", "seq").collect()
    assert [(r["status"], r["attempt"]) for r in order] == [("retrying", 2), ("retrying", 3), ("failed", 3), ("completed", 1)]


def test_no_documents_and_repeated_ones(spark, tmp_path):
    docs, path = documents(spark, 1), str(tmp_path / "run")
    calls = tmp_path / "calls"
    calls.mkdir()
    resume.run_in_batches(docs.unionByName(docs), counting(str(calls)), path, max_chars=1000)
    assert len(asked(calls)) == 3
    with pytest.raises(ValueError):
        resume.stored_run(docs, str(tmp_path / "nothing"))
    resume.run_in_batches(docs.filter("false"), counting(str(calls)), str(tmp_path / "none"), max_chars=1000)
    assert len(asked(calls)) == 3


def test_a_run_has_a_bounded_number_of_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(resume, "MOST_BATCHES", 2)
    batches = []
    docs = documents(spark, 6, parts=1)
    resume.run_in_batches(docs, generation.rule_based_generator, f"{tmp_path}/runs", batch_chunks=1, files_per_batch=1, on_batch=batches.append)
    assert len(batches) == 2
    stored = resume.stored_calls(docs, f"{tmp_path}/runs").collect()
    assert len(stored) == 6 and all(r["calls"] == 1 for r in stored)
