from pyspark.sql import functions as F

from quillset.operators.evidence import bind_to_chunks, with_evidence, with_no_evidence
from quillset.operators.quality import FLAG_NO_EVIDENCE, build_records, infer_task_type, rescore


def test_grounded_record_is_traceable(spark):
    chunk = spark.createDataFrame(
        [("d1", "chunk_001", "说明.md", "md", "格式", 10, "本工具支持 PDF、Word、PowerPoint、TXT、Markdown 和 HTML 文档。")],
        "document_id string, chunk_id string, source_name string, file_type string, heading string, start_offset bigint, text string",
    ).withColumn("end_offset", F.lit(80).cast("bigint"))
    item = spark.createDataFrame(
        [("d1", "chunk_001", " 本工具支持哪些格式？ ", None, "本工具支持 PDF、Word、PowerPoint、TXT、Markdown 和 HTML。")],
        "document_id string, chunk_id string, instruction string, input string, output string",
    )
    record = build_records(bind_to_chunks(item, chunk, "document_id", "chunk_id")).first()
    assert record["id"].startswith("qa_") and record["review_status"] == "pending"
    assert record["instruction"] == "本工具支持哪些格式？" and record["input"] == ""
    assert record["source"]["start_offset"] == 10 and record["quality"]["groundedness"] >= 0.75
    assert 0 <= record["quality"]["overall"] <= 1
    again = rescore(spark.createDataFrame([record], bind_schema(spark, item, chunk))).first()
    assert again["quality"] == record["quality"]


def bind_schema(spark, item, chunk):
    return build_records(bind_to_chunks(item, chunk, "document_id", "chunk_id")).schema


def test_missing_evidence_is_never_grounded(spark):
    item = spark.createDataFrame([("旧问题是什么？", "", "旧答案")], "instruction string, input string, output string")
    sourced = with_no_evidence(item, F.lit("x"), F.lit("旧数据"), F.lit("txt"), F.lit("c1"))
    quality = build_records(sourced).first()["quality"]
    assert quality["groundedness"] == 0 and quality["evidence_available"] is False
    assert FLAG_NO_EVIDENCE in quality["flags"]


def test_evidence_windows(spark):
    text = "x" * 1000 + " the needle sentence sits here " + "y" * 1000
    data = [
        (0, "short chunk", "whatever"),
        (1, text, "Intro. the needle sentence sits here!"),
        (2, text, "the  needle  sentence  sits  here"),
        (3, text, "0123456789 987654321"),
    ]
    got = {r["k"]: r["evidence"] for r in with_evidence(spark.createDataFrame(data, "k int, chunk_text string, output string")).collect()}
    assert got[0]["text"] == "short chunk" and got[0]["available"]
    start = text.index("the needle") - 280
    assert got[1]["start"] == start and got[1]["end"] == start + 800
    assert got[1]["text"] == "…" + text[start : start + 800] + "…"
    assert got[2]["available"] and "needle" in got[2]["text"]
    assert (got[3]["available"], got[3]["text"], got[3]["start"], got[3]["end"]) == (False, "", 0, len(text))


def test_task_types(spark):
    data = [("列出步骤", ""), ("为什么失败", ""), ("随便", "上下文"), ("名称", " 　")]
    df = spark.createDataFrame(data, "instruction string, input string")
    assert [r[0] for r in df.select(infer_task_type()).collect()] == ["extraction", "analysis", "reading_comprehension", "closed_book_qa"]
