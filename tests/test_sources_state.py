import json
import zipfile

from pyspark.sql import functions as F

from quillset.operators import checkpoints, export, history, running
from quillset.sources import files, pages, sessions
from tests.records import make_records


def test_only_accepted_rows_are_exported_without_metadata(rows, tmp_path):
    records = make_records(rows, [
        {"instruction": "kept", "output": "a", "review_status": "accepted", "file_name": "a.b.md"},
        {"instruction": "open", "output": "b", "file_name": "c.md"},
        {"instruction": "with input", "input": "ctx", "output": "c", "review_status": "accepted", "file_name": "a.b.md"},
    ])
    spark = records.sparkSession
    export.write_export(records, f"{tmp_path}/one", "alpaca")
    lines = [json.loads(r[0]) for r in spark.read.text(f"{tmp_path}/one").collect()]
    assert sorted(d["instruction"] for d in lines) == ["kept", "with input"]
    assert all(list(d) == ["instruction", "input", "output"] for d in lines)
    states = spark.createDataFrame([("a.b.md", "done"), ("c.md", "done")], "file_name string, status string")
    export.write_per_file(records, states, f"{tmp_path}/per", "sharegpt")
    per = spark.read.json(f"{tmp_path}/per")
    assert {r[0] for r in per.select("export_name").collect()} == {"a.b_sharegpt.json"}
    values = sorted(r[0] for r in per.select(F.col("conversations")[0]["value"]).collect())
    assert values == ["kept", "with input\n\nctx"]
    export.write_combined(records, states.filter("file_name = 'c.md'"), f"{tmp_path}/none")
    unmanaged = export.exportable(records.drop("review_status"))
    assert unmanaged.count() == 3


def test_documents_from_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\n\n\n two ", encoding="utf-8")
    (tmp_path / "b.MD").write_text("# t\nbody", encoding="utf-8")
    (tmp_path / "c.htm").write_text("<h1>T</h1><p>x</p>", encoding="utf-8")
    (tmp_path / "d.csv").write_text("no", encoding="utf-8")
    slide = lambda *paras: "<p>" + "".join(f"<a:p><a:r><a:t>{a}</a:t></a:r><a:r><a:t> {b} </a:t></a:r></a:p>" for a, b in paras) + "</p>"
    with zipfile.ZipFile(tmp_path / "e.pptx", "w") as deck:
        deck.writestr("ppt/slides/slide10.xml", slide(("ten", "x")))
        deck.writestr("ppt/slides/slide2.xml", slide(("two", "a"), ("more", "b")))
        deck.writestr("ppt/slides/slide3.xml", "<p></p>")
    with zipfile.ZipFile(tmp_path / "f.pptx", "w") as deck:
        deck.writestr("other.xml", "x")
    got = {r["source_name"]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.txt", "b.MD", "c.htm", "e.pptx", "f.pptx"}
    assert got["a.txt"]["text"] == "one\n\ntwo" and got["a.txt"]["paragraph_count"] == 2
    assert got["c.htm"]["text"] == "# T\nx" and got["b.MD"]["file_type"] == "md"
    assert got["e.pptx"]["text"] == "=== 第 2 页 ===\ntwoa\nmoreb\n\n=== 第 10 页 ===\ntenx"
    assert got["f.pptx"]["text"] == files.NO_SLIDES


def test_every_upload_has_an_outcome(spark, tmp_path):
    for name, body in {"a.txt": b"text", "b.pdf": b"%PDF", "c.DOCX": b"PK", "d.csv": b"1", "e.ppt": b"\xd0\xcf\x11\xe0", "f.md": b" \n "}.items():
        (tmp_path / name).write_bytes(body)
    with zipfile.ZipFile(tmp_path / "g.pptx", "w", zipfile.ZIP_DEFLATED) as deck:
        deck.writestr("ppt/slides/slide1.xml", "<a:p><a:t>one</a:t></a:p>" * 500)
    whole = (tmp_path / "g.pptx").read_bytes()
    (tmp_path / "h.pptx").write_bytes(whole[:60] + b"\xff" * 20 + whole[80:])
    (tmp_path / "i.pptx").write_bytes(whole[:200])
    (tmp_path / "j.html").write_bytes(b"x" * (files.MAX_FILE_BYTES + 1))
    got = {r["source_name"]: r for r in files.read_uploads(spark, str(tmp_path)).collect()}
    assert {k: r["reject_reason"] for k, r in got.items()} == {
        "a.txt": None, "b.pdf": "needs_converter", "c.DOCX": "needs_converter", "d.csv": "unsupported_type", "e.ppt": "unreadable",
        "f.md": "empty", "g.pptx": None, "h.pptx": "unreadable", "i.pptx": "unreadable", "j.html": "too_large",
    }
    assert all((r["reject_reason"] == "unreadable") == (r["message"] is not None) for r in got.values())
    assert all((r["reject_reason"] is None) == (r["document_id"] is not None) for r in got.values()) and got["a.txt"]["char_count"] == 4
    assert {r["source_name"] for r in files.read_documents(spark, str(tmp_path)).collect()} == {"a.txt", "g.pptx"}


def test_size_limit_is_strict(spark):
    df = spark.createDataFrame([("a.txt", 10 * 1024 * 1024), ("b.txt", 10 * 1024 * 1024 + 1), ("c", 1)], "file_name string, file_size long")
    assert [r["reject_reason"] for r in files.gate_uploads(df).collect()] == [None, "too_large", "unsupported_type"]


def test_scanned_pages(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "word " * 20)], "k int, page_no int, text string")
    got = {r["k"]: r for r in pages.assemble_pages(df, "k").collect()}
    assert got[1]["text"] == "=== 第 1 页 ===\na\n\n=== 第 2 页 ===\nb" and not got[2]["maybe_scanned"]


def test_round_log_valid_prefix(spark, tmp_path):
    for name, lines in {
        "s1": ['{"round":1,"items":[{"instruction":"q","input":"","output":"a"}]}', "", '{"round":2,"items":[]}'],
        "s2": ['{"round":1,"items":[]}', '{"round":"2","items":[]}', '{"round":3,"items":[]}'],
        "s3": ["oops"],
    }.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "progress.jsonl").write_text("\n".join(lines) + "\n")
    got = sessions.valid_rounds(sessions.read_round_logs(spark, str(tmp_path))).orderBy("session_id", "round").collect()
    assert [(r["session_id"], r["round"], r["truncated"]) for r in got] == [("s1", 1, False), ("s1", 2, False), ("s2", 1, True)]
    items = sessions.round_items(sessions.valid_rounds(sessions.read_round_logs(spark, str(tmp_path)))).collect()
    assert [(r["session_id"], r["instruction"]) for r in items] == [("s1", "q")]


def test_append_rounds_and_sessions(spark, tmp_path):
    df = spark.createDataFrame([("s1", 1, [("q", "", "a")])], "session_id string, round int, items array<struct<instruction:string,input:string,output:string>>")
    sessions.append_rounds(df, f"{tmp_path}/log")
    sessions.append_rounds(df.withColumn("round", F.lit(2)), f"{tmp_path}/log")
    odd = df.withColumns({"round": F.lit(3), "session_id": F.lit("a:b/c %41"), "items": F.array(F.struct(F.lit('say "é"\n').alias("instruction"), F.lit("").alias("input"), F.lit("\\").alias("output")))})
    sessions.append_rounds(odd, f"{tmp_path}/log")
    back = sessions.read_appended(spark, f"{tmp_path}/log").orderBy("session_id", "line_no").collect()
    assert [(r["session_id"], r["line_no"]) for r in back] == [("a:b/c %41", 0), ("s1", 0), ("s1", 1)]
    items = sessions.round_items(sessions.valid_rounds(sessions.read_appended(spark, f"{tmp_path}/log"))).orderBy("session_id", "round").collect()
    assert [(r["round"], r["instruction"], r["output"]) for r in items] == [(3, 'say "é"\n', "\\"), (1, "q", "a"), (2, "q", "a")]
    for name, body in {"a": '{"sessionId":"a","status":"running","updatedAt":5}', "b": '{"sessionId":"b","status":"completed","updatedAt":9}', "c": "{broken"}.items():
        (tmp_path / "meta" / name).mkdir(parents=True)
        (tmp_path / "meta" / name / "meta.json").write_text(body)
    metas = sessions.read_sessions(spark, f"{tmp_path}/meta")
    assert {r["session_id"] for r in metas.collect()} == {"a", "b"}
    assert [r["session_id"] for r in history.pending_sessions(metas).collect()] == ["a"]
    keep, gone = history.split_expired(metas, F.lit(10), max_age_ms=4)
    assert [r["session_id"] for r in keep.collect()] == ["b"] and [r["session_id"] for r in gone.collect()] == ["a"]


def test_stored_lists_are_promoted(rows, tmp_path):
    records = make_records(rows, [{"instruction": "q", "output": "a"}])
    kept = records.select("id", "instruction", "input", "output", "review_status", "quality", "source")
    complete = kept.first().asDict(recursive=True)
    (tmp_path / "list.json").write_text(json.dumps([complete, {"instruction": " old ", "output": "x"}, {**complete, "id": ""}]))
    stored = sessions.read_stored(records.sparkSession, str(tmp_path / "list.json"), kept.schema).orderBy("pos").collect()
    assert [r["source"]["chunk_id"] for r in stored] == ["r0", "legacy_002", "legacy_003"]
    assert stored[0]["quality"]["overall"] == 0.9 and stored[1]["instruction"] == "old" and stored[1]["created_at"] == 0


def test_resume_needs_the_exact_fingerprint(spark, tmp_path):
    run = spark.createDataFrame([("s", "fp-a")], "session_id string, fingerprint string")
    stored = spark.createDataFrame([("s", "fp-a", 1), ("s", "fp-b", 1), ("s", "fp-a", 2)], "session_id string, fingerprint string, schema_version int")
    assert [(r["fingerprint"], r["schema_version"]) for r in checkpoints.compatible(stored, run).collect()] == [("fp-a", 1)]
    path = f"{tmp_path}/state"
    assert checkpoints.load_completed(spark, path, run) == (None, None)
    done = lambda *ids: spark.createDataFrame([("s", "fp-a", i) for i in ids], "session_id string, fingerprint string, chunk_id string")
    recs = lambda *ids: done(*ids).withColumn("instruction", F.concat(F.lit("q"), "chunk_id"))
    checkpoints.save_completed(spark, path, done("c1"), recs("c1"))
    checkpoints.save_completed(spark, path, done("c1", "c2"), recs("c1", "c2"))
    markers, records = checkpoints.load_completed(spark, path, run)
    assert sorted(r["chunk_id"] for r in markers.collect()) == ["c1", "c2"]
    assert sorted(r["instruction"] for r in records.collect()) == ["qc1", "qc2"]
    left = checkpoints.pending_chunks(done("c1", "c2", "c3"), markers)
    assert [r["chunk_id"] for r in left.collect()] == ["c3"]
    other = checkpoints.pending_chunks(done("c1").withColumn("session_id", F.lit("t")), markers)
    assert other.count() == 1
    assert checkpoints.load_completed(spark, path, run.withColumn("session_id", F.lit("t")))[0].count() == 0


def test_running_totals_of_one_big_key(spark):
    df = spark.range(1000).select(F.lit("run").alias("k"), "id", (F.col("id") % 3).alias("v"))
    got = {r["id"]: r["t"] for r in running.running_totals(df, ["k"], "id", {"t": "v"}, run_length=64).collect()}
    total = 0
    for i in range(1000):
        total += i % 3
        assert got[i] == total


def test_history_keeps_the_newest(spark, tmp_path):
    for i in range(3):
        history.append_run(spark.createDataFrame([(i, i * 10)], "run_id long, created_at long"), f"{tmp_path}/h")
    assert [r["run_id"] for r in history.latest_runs(spark.read.parquet(f"{tmp_path}/h"), 2).collect()] == [2, 1]
