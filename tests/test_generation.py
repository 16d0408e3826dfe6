import json

from pyspark.sql import functions as F

from quillset.operators import dedup, generation, requests, responses
from quillset.sources.files import with_document_columns
from quillset.streaming import progress


def documents(spark, *texts):
    df = spark.createDataFrame([(f"d{i}.md", "md", t) for i, t in enumerate(texts)], "source_name string, file_type string, text string")
    return with_document_columns(df)


def answer(*pairs):
    return json.dumps({"items": [{"instruction": q, "input": "", "output": a} for q, a in pairs]})


def parse(spark, *raws):
    df = spark.createDataFrame(list(enumerate(raws)), "k int, raw_content string")
    counts = {r["k"]: r for r in responses.parse_summary(df, "k").collect()}
    return counts, responses.parse_items(df, "k").orderBy("k", "item_no").collect()


def test_parsing_strategies(spark):
    good = '{"instruction": "q", "output": "a"}'
    counts, items = parse(
        spark,
        f"[{good}]",
        f'x ```json\n{{"dataset": [{good}]}}\n``` y',
        "{'records': [" + good.replace('"', "'") + ",],}",
        '{"items": 5, "data": [' + good + "]}",
        '[{"instruction": "q", "output": "a", "input": null}, {"instruction": 1, "output": "a"}, 7, null]',
        "null",
        "5",
        '{"a": NaN}',
        '{"items": []} trailing',
        '{"items": [], "items": [' + good + "]}",
        None,
    )
    assert [counts[i]["strategy"] for i in range(11)] == [
        "direct", "fenced", "repaired", "direct", "direct", "none", "direct", "none", "repaired", "direct", "empty",
    ]
    assert [counts[i]["valid_count"] for i in range(11)] == [1, 1, 1, 1, 0, 0, 0, 0, 0, 1, 0]
    assert counts[4]["total_count"] == 4 and len(counts[4]["parse_errors"]) == 4
    assert counts[6]["parse_errors"] == [] and counts[8]["parse_errors"] == [responses.REPAIRED]
    assert [i["valid"] for i in items if i["k"] == 4] == [False] * 4


def test_retries_continuation_and_failures(spark):
    docs = documents(spark, "# A\nalpha text", "# B\nbeta text", "# C\ngamma text")

    def generator(batch):
        rows = []
        for system, user in zip(batch["system"], batch["user"]):
            if "alpha" in user:
                if "Questions so far" in user:
                    rows.append((answer(("second", "more")), "stop", 1, 1, None))
                else:
                    rows.append((answer(("first", "alpha text")), "length", 1, 1, None))
            elif "beta" in user:
                rows.append(("not json", "stop", 1, 1, None))
            else:
                rows.append((None, None, None, None, "timeout"))
        return rows

    records, run = generation.extract_records(docs, generator, created_at=F.lit(1))
    got = records.orderBy("pos").collect()
    assert [r["instruction"] for r in got] == ["first", "second"]
    assert got[0]["source"]["heading"] == "A" and got[0]["source"]["available"]
    failures = {r["message"]: r["attempts"] for r in run.failures.collect()}
    assert failures == {"timeout": 3, responses.UNPARSABLE: 3}
    assert run.parse_errors.filter("stage = 1").count() == 3
    totals = generation.run_totals(run, records, records).orderBy(F.desc("total_before_dedup")).first()
    assert totals["total_before_dedup"] == 2 and totals["failed_chunks"] == 0


def test_deep_rounds_stop_conditions(spark):
    docs = documents(spark, "alpha", "beta", "gamma", "delta").withColumn("session_id", F.col("text"))

    def generator(batch):
        rows = []
        for user in batch["user"]:
            name = next(n for n in ("alpha", "beta", "gamma", "delta") if n in user)
            number = int(user.split(":")[0].split()[1]) if user.startswith("Round") else 1
            fresh = f"{name} question number {number * 7919} about {'xyzuvw'[number] * 5}"
            if name == "alpha":
                rows.append((answer((fresh, "a")), "stop", 1, 1, None))
            elif name == "beta":
                rows.append((answer(("always the same", "a")), "length", 1, 1, None))
            else:
                rows.append((answer((fresh, "a"), (fresh[::-1], "b")), "length", 1, 1, None))
        return rows

    items, rounds = generation.deep_rounds(docs, generator, max_rounds=4)
    last = {r["session_id"]: (r["n"], r["last"]) for r in rounds.groupBy("session_id").agg(F.count("*").alias("n"), F.max("round").alias("last")).collect()}
    assert last == {"alpha": (1, 1), "beta": (2, 2), "gamma": (4, 4), "delta": (4, 4)}
    assert items.filter("session_id = 'beta'").count() == 1 and items.filter("session_id = 'gamma'").count() == 8
    _, own = generation.deep_rounds(docs.filter("text = 'gamma'"), generator, max_rounds=4, threshold=0.45, compare_with="self")
    assert own.agg(F.max("round")).first()[0] == 2
    past = items.filter("session_id = 'gamma' AND round <= 2")
    resumed, more = generation.deep_rounds(docs.filter("text = 'gamma'"), generator, max_rounds=3, history=past)
    assert more.count() == 1 and resumed.count() == 6


def test_deep_rounds_keep_failures_and_ask_about_every_part(spark):
    long = "\n".join(f"# H{i}\nfact number {i} is {'abcdefgh'[i] * 12}" for i in range(8))
    docs = documents(spark, long, "short", "down").withColumn("session_id", F.col("source_name"))

    def generator(batch, broken=True):
        rows = []
        for user in batch["user"]:
            source = user.split("<source>\n", 1)[1].rsplit("\n</source>", 1)[0]
            number = int(user.split(":")[0].split()[1]) if user.startswith("Round") else 1
            if source == "down" and number == 2 and broken:
                rows.append((None, None, None, None, "timeout"))
            else:
                rows.append((answer((f"{source} {number * 7919} {'xyzuvw'[number] * 9}", source)), "stop" if source == "short" or "H3" in source else "length", 1, 1, None))
        return rows

    items, rounds = generation.deep_rounds(docs, generator, max_rounds=2, limit=60)
    told = {(r["session_id"], r["round"]): r for r in rounds.collect()}
    assert {k: r["stop_reason"] for k, r in told.items()} == {
        ("d0.md", 1): None, ("d0.md", 2): "round_limit", ("d1.md", 1): "finished", ("d2.md", 1): None, ("d2.md", 2): "failed",
    }
    assert told["d0.md", 1]["valid_count"] == 8 and told["d0.md", 1]["prompt_tokens"] == 8 and told["d0.md", 2]["total_items"] == 16
    assert told["d0.md", 1]["finish_reason"] == "length" and told["d2.md", 2]["error"] == "timeout" and told["d2.md", 2]["valid_count"] == 0
    first = items.filter("session_id = 'd0.md' AND round = 1").orderBy("item_no").collect()
    assert [r["item_no"] for r in first] == list(range(1, 9)) and ["".join(r["output"]) for r in first] == long.replace("\n#", "\n\0#").split("\0")
    # The session that failed is open: the next run begins with its failed round.
    again, more = generation.deep_rounds(docs.filter("source_name = 'd2.md'"), lambda b: generator(b, False), max_rounds=2, history=items)
    assert [(r["round"], r["total_items"], r["stop_reason"]) for r in more.collect()] == [(2, 2, "round_limit")]
    assert again.filter("session_id = 'd2.md'").count() == 2
    events = progress.round_events(rounds).filter("run_id IN ('d1.md', 'd2.md')").orderBy("run_id", "seq").collect()
    assert [(e["run_id"], e["type"], e["seq"], e["status"], e["message"]) for e in events] == [
        ("d1.md", "round", 1, "completed", None), ("d1.md", "done", 2, "finished", None),
        ("d2.md", "round", 1, "completed", None), ("d2.md", "round", 3, "failed", "timeout"),
    ]


def test_requests_lose_nothing_of_a_long_document(spark):
    text = "".join(f"sentence {i} of this text。" for i in range(400))
    docs = spark.createDataFrame(
        [(1, "a.txt", "txt", text), (2, "b.txt", "txt", "x" * 50), (3, "c.txt", "txt", None), (4, "d.txt", "txt", "")], "doc_id long, source_name string, file_type string, text string"
    ).withColumn("char_count", F.coalesce(F.length("text"), F.lit(0)).cast("bigint"))
    got = requests.single_requests(docs, limit=50).orderBy("doc_id", "part_no").collect()
    assert [(r["doc_id"], r["part_no"], r["part_total"]) for r in got] == [(1, 1, 2), (1, 2, 2), (2, 1, 1), (3, 1, 1), (4, 1, 1)]
    sent = [r["request"]["messages"][1]["content"].split("<source>\n", 1)[1].rsplit("\n</source>", 1)[0] for r in got]
    assert text.startswith(sent[0]) and text.endswith(sent[1]) and len(sent[0]) + len(sent[1]) >= len(text) and sent[2:] == ["x" * 50, "", ""]
    assert "Part: 1/2" in got[0]["request"]["messages"][1]["content"] and "Part:" not in got[2]["request"]["messages"][1]["content"]


def test_older_run_fails_per_document(spark):
    docs = documents(spark, "# A\nalpha text\n# B\nbeta text is longer", "# C\ngamma\n# D\ndelta", "# E\nepsilon")

    def generator(batch):
        answers = generation.rule_based_generator(batch)
        return [(None, None, None, None, "down") if "gamma" in user else a for user, a in zip(batch["user"], answers)]

    items, failures = generation.extract_items_by_paragraph(docs, generator)
    assert sorted(r["instruction"] for r in items.collect()) == ["A", "B", "E"]
    failed = docs.filter("source_name = 'd1.md'").first()["document_id"]
    assert [tuple(r) for r in failures.collect()] == [(failed, 1, "down")]


def test_deep_rounds_without_a_limit_ask_once_about_a_long_page(spark, tmp_path):
    from quillset.plans.registry import deep_rounds

    body = "".join(f"<p>Sentence number {i} of a long page.</p>" for i in range(3000))
    spark.createDataFrame([(7, "u", f"<h1>Long</h1>{body}")], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [(r["session_id"], r["valid_count"], r["stop_reason"]) for r in deep_rounds(spark, str(tmp_path)).collect()] == [("page_7.html", 1, "finished")]


def sharing_an_id(spark):
    docs = documents(spark, "# A\nalpha text\n# B\nbeta text is longer", "# C\ngamma\n# D\ndelta is here")
    return docs.withColumn("document_id", F.lit("doc_same"))


def test_documents_that_share_an_id_keep_their_own_records(spark):
    records, run = generation.extract_records(sharing_an_id(spark), generation.rule_based_generator, created_at=F.lit(0))
    got = sorted((r["source"]["file_name"], r["instruction"], r["place"]) for r in records.collect())
    assert [(f, q) for f, q, _ in got] == [("d0.md", "A"), ("d0.md", "B"), ("d1.md", "C"), ("d1.md", "D")]
    assert sorted(place for _, _, place in got) == [1, 2, 3, 4]
    kept, _ = dedup.deduplicate_records(records.withColumn("document", F.col("source.document_id")), "document", position="place")
    totals = generation.run_totals(run, records, kept).first()
    assert (totals["total_chunks"], totals["total_before_dedup"], totals["total_after_dedup"]) == (4, 4, kept.count())


def test_older_run_tells_documents_apart_that_share_an_id(spark):
    def generator(batch):
        answers = generation.rule_based_generator(batch)
        return [(None, None, None, None, "down") if "gamma" in user else a for user, a in zip(batch["user"], answers)]

    items, failures = generation.extract_items_by_paragraph(sharing_an_id(spark), generation.rule_based_generator)
    assert sorted(r["instruction"] for r in items.collect()) == ["A", "B", "C", "D"]
    items, failures = generation.extract_items_by_paragraph(sharing_an_id(spark), generator)
    assert sorted(r["instruction"] for r in items.collect()) == ["A", "B"]
    assert [(r["failed_calls"], r["error"]) for r in failures.collect()] == [(1, "down")]


def test_calls_reach_a_generator_in_small_batches(spark):
    from quillset.session import BATCH_ROWS, checkpointed

    chunk = "struct(array(struct('s' AS content), struct(cast(id AS string) AS content)) AS messages, 0.5D AS temperature, 10 AS max_tokens) AS request"
    asked = spark.range(0, 3 * BATCH_ROWS, 1, 1).selectExpr("id", chunk)

    def generator(batch):
        return [("[]", "stop", len(batch), 1, None)] * len(batch)

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    calls = checkpointed(generation.run_generator(asked, generator, "id"))
    assert calls.count() == 3 * BATCH_ROWS
    assert calls.agg(F.max("prompt_tokens")).first()[0] == BATCH_ROWS
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
