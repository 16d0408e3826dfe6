import random
import re

from pyspark.sql import functions as F

from quillset.operators.chunking import chunk_documents, chunk_documents_by_paragraph, sections_of

BLANK = "\t\n\x0b\x0c\r  　"


def spec_chunks(text, limit, overlap):
    """Cut points written down directly: sections first, then windows of each section."""
    if not text.strip(BLANK):
        return []
    marks = [m.start() for m in re.finditer(r"(?m)^#{1,6}\s+.+$", text)]
    edges = sorted({0, *marks, len(text)})
    spans = list(zip(edges, edges[1:]))
    if marks and marks[0] > 0 and not text[: marks[0]].strip(BLANK):
        spans = spans[1:]
    out = []
    for low, high in spans:
        at = low
        while True:
            end = min(at + limit, high)
            if end < high:
                begin = at + int((end - at) * 0.45)
                ends = [i + 1 for i in range(begin, end) if text[i] in "\n。！？"]
                end = max(at + 1, ends[-1]) if ends else end
            out.append((at, end))
            if end >= high:
                break
            at = max(at + 1, end - overlap)
    return out


def test_preface_headings_and_offsets(spark):
    body = "开头说明不能丢。\n\n# 一\n同样的话。同样的话。这里说明参数怎么写。\n\n# 二\n同样的话。同样的话。这里说明怎么审核。"
    df = spark.createDataFrame([("d", body)], "k string, text string")
    got = chunk_documents(df, "k", max_chars=42, overlap_chars=10).orderBy("chunk_index").collect()
    assert got[0]["heading"] == "前言" and {"一", "二"} <= {c["heading"] for c in got}
    assert all(c["text"] == body[c["start_offset"] : c["end_offset"]] for c in got)
    assert [c["chunk_id"] for c in got] == [f"chunk_{i:03d}" for i in range(1, len(got) + 1)]
    assert {c["chunk_total"] for c in got} == {len(got)}


def test_overlap_stays_inside_its_section(spark):
    df = spark.createDataFrame([("d", "# First\nonly about the first\n# Second\nonly about the second")], "k string, text string")
    second = [c for c in chunk_documents(df, "k", max_chars=40, overlap_chars=12).collect() if c["heading"] == "Second"]
    assert second and all("about the first" not in c["text"] for c in second)


def test_heading_kinds_and_blank_documents(spark):
    text = "=== 第 1 页 ===\nbody\n第三章 结果\nmore\n###### deep\nend\n####### not a heading"
    df = spark.createDataFrame([("a", text), ("b", " 　\n")], "k string, text string")
    got = sections_of(df, "k").orderBy("section_index").collect()
    assert [(s["k"], s["heading"]) for s in got] == [("a", "第 1 页"), ("a", "第三章 结果"), ("a", "deep")]


def test_random_texts_equal_the_specification(spark):
    rng = random.Random(11)
    alphabet = "abc中文\n。# "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 160))) for _ in range(300)]
    for limit, overlap in ((32, 12), (40, 0), (64, 25)):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string").repartition(7)
        got: dict[int, list] = {}
        for c in chunk_documents(df, "k", max_chars=limit, overlap_chars=overlap).collect():
            got.setdefault(c["k"], []).append((c["start_offset"], c["end_offset"]))
            assert texts[c["k"]][c["start_offset"] : c["end_offset"]] == c["text"]
        for i, t in enumerate(texts):
            assert sorted(got.get(i, [])) == spec_chunks(t, limit, min(overlap, int(0.4 * limit))), repr(t)


def test_older_chunker_drops_the_preface_and_finds_first_occurrence(spark):
    text = "lost preface\n## Part\n" + "same line here. " * 8 + "\n\n" + "tail words " * 10
    df = spark.createDataFrame([("d", text)], "k string, text string")
    got = chunk_documents_by_paragraph(df, "k", max_chars=100, overlap_chars=10).orderBy("chunk_index").collect()
    assert got[0]["heading"] == "Part" and got[0]["text"].startswith("## Part")
    assert all("lost" not in c["text"] for c in got)
    assert all(c["start_offset"] == max(text.find(c["text"][:50].strip()), 0) for c in got)
    raw = chunk_documents_by_paragraph(df, "k", max_chars=100, set_total=False).select("chunk_total").distinct().collect()
    assert [r[0] for r in raw] == [0]


def test_chunking_plan_has_no_shuffle(spark):
    df = spark.range(10).select(F.col("id").alias("k"), F.lit("# a\nb").alias("text"))
    plan = chunk_documents(df, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1
