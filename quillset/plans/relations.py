"""Relations derived from the given tables; every registered query starts from one of these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillset.functions.text import js_trim
from quillset.sources.pages import pages_to_documents


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose text is costly to process: an input with fewer splits than cores is spread over all of them."""
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def pages_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_to_documents(text_table(spark, sf_dir, "pages"))


def doc_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        "n_chars",
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_name"),
        F.lit("txt").alias("file_type"),
        "text",
    )


def conv_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn and the assistant turn right after it. (conv_id, turn) is unique, so the join key has no hot value."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("instruction"))
    told = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return asked.join(told, ["conv_id", "turn"]).select(
        "conv_id",
        "turn",
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"),
        "instruction",
        F.lit("").alias("input"),
        "output",
    )


# Words put before derived questions so that every rule about Chinese wording is exercised on the given rows.
HAN_PREFIXES = ("请提取", "如何设置模型", "怎样配置模型的步骤", "这个", "为什么", "列出方法", "分析影响", "请问流程是", "", "上述内容")
HAN_ANSWERS = ("详见文档", "先登录后台再保存参数", "略", "可以选导出格式并逐条核对", "")


def _pick(words: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (index % len(words) + 1).cast("int"))


def han_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_qa with Chinese wording in front of whole questions and answers; every eleventh conversation has an input too."""
    index = F.col("conv_id") + F.col("turn")
    return conv_qa(spark, sf_dir).select(
        "conv_id",
        "turn",
        "pos",
        F.concat(_pick(HAN_PREFIXES, index), F.col("instruction")).alias("instruction"),
        F.when(F.col("conv_id") % 11 == 0, F.col("output")).otherwise(F.lit("")).alias("input"),
        F.concat(_pick(HAN_ANSWERS, index), F.col("output")).alias("output"),
    )


def _question_and_answer(texts: DataFrame, variant: Column) -> DataFrame:
    """Add instruction (first sentence of ``text``), input and output (longest other sentence); rows without a sentence go.

    Answers of variant 1 are spaced out so they no longer occur verbatim, those of variant 2 are unrelated to the text.
    """
    sentences = F.filter(F.transform(F.split("text", "[.!?\\n]", -1), js_trim), lambda s: s != "")
    cut = texts.withColumn("__s", sentences).filter(F.size("__s") > 0)
    others = F.slice("__s", 2, F.greatest(F.size("__s"), F.lit(1)))
    longest = F.array_sort(F.transform(others, lambda s, i: F.struct((-F.length(s)).alias("k"), i.alias("i"), s.alias("s"))))
    # Filters on what follows may be tried before that on the size, so a text without a sentence must give null and not an error.
    first = F.try_element_at("__s", F.lit(1))
    answer = F.coalesce(F.try_element_at(longest, F.lit(1))["s"], first)
    return cut.withColumn("__answer", answer).withColumns(
        {
            "instruction": first,
            "input": F.lit(""),
            "output": F.when(variant == 1, F.regexp_replace("__answer", " ", "  ")).when(variant == 2, F.md5("__answer")).otherwise(F.col("__answer")),
        }
    ).drop("__s", "__answer")


def doc_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pair per document: every third answer is spaced out, every third unrelated."""
    return _question_and_answer(doc_txt(spark, sf_dir), F.col("doc_id") % 3).select(
        "doc_id",
        F.concat(F.lit("d_"), F.col("doc_id").cast("string")).alias("document_id"),
        "source",
        "source_name",
        "file_type",
        "instruction",
        "input",
        "output",
        F.col("text").alias("chunk_text"),
    )


def chunk_qa(chunks: DataFrame, *keys: str) -> DataFrame:
    """One pair per chunk, from the chunk's own text; the variant of the answer follows the chunk's number."""
    return _question_and_answer(chunks, F.col("chunk_index") % 3).select(*keys, "chunk_id", "instruction", "input", "output")


def status_from_labels(quality: Column, toxic: Column) -> Column:
    return (
        F.when(toxic == 1, "rejected").when(quality == 1, "accepted").when(quality == 0, "needs_revision").otherwise("pending")
    )


NAME_SUFFIXES = (".pdf", ".DOCX", ".pptx", ".ppt", ".txt", ".md", ".Markdown", ".HTML", ".htm", ".csv", "", ".tar.gz")


def upload_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listed file per document, with every accepted extension, unknown ones and none, and sizes around the limit."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), _pick(NAME_SUFFIXES, F.col("doc_id"))).alias("file_name"),
        (F.col("n_chars") * 1000).alias("file_size"),
    )


def upload_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of ``upload_names`` with the document's text as their bytes; what is named a slide archive is none."""
    docs = text_table(spark, sf_dir, "documents")
    name = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), _pick(NAME_SUFFIXES, F.col("doc_id")))
    return docs.select(F.concat(F.lit("uploads/"), name).alias("path"), (F.col("n_chars") * 1000).alias("length"), F.encode("text", "UTF-8").alias("content"))


CONVERSATIONS_PER_FILE = 16


def _sourced(items: DataFrame) -> DataFrame:
    from quillset.operators.evidence import with_no_evidence

    book = F.floor(F.col("conv_id") / CONVERSATIONS_PER_FILE).cast("string")
    return with_no_evidence(
        items,
        F.concat(F.lit("conv_"), book),
        F.concat(F.lit("conv_"), book, F.lit(".txt")),
        F.lit("txt"),
        F.concat(F.lit("chunk_"), F.col("conv_id").cast("string")),
    )


def conv_records(spark: SparkSession, sf_dir: str, items=conv_qa) -> DataFrame:
    """Review records of the conversation pairs; 16 conversations make one source file, statuses follow the position."""
    from quillset.operators.quality import build_records

    records = build_records(_sourced(items(spark, sf_dir)), created_at=F.col("pos"))
    return records.withColumn("review_status", _pick(("pending", "accepted", "rejected", "needs_revision", "accepted"), F.col("conv_id")))


def doc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review records of the document pairs with localised evidence and statuses from ``labels``."""
    from quillset.operators.evidence import with_evidence
    from quillset.operators.quality import build_records

    located = with_evidence(doc_qa(spark, sf_dir))
    source = F.struct(
        "document_id",
        F.col("source_name").alias("file_name"),
        "file_type",
        F.lit("chunk_001").alias("chunk_id"),
        F.lit(None).cast("string").alias("heading"),
        F.col("evidence.start").alias("start_offset"),
        F.col("evidence.end").alias("end_offset"),
        F.col("evidence.text").alias("text"),
        F.col("evidence.available").alias("available"),
    )
    items = located.select("doc_id", F.col("source").alias("origin"), source.alias("source"), "instruction", "input", "output")
    records = build_records(items, created_at=F.col("doc_id"))
    labels = table(spark, sf_dir, "labels")
    joined = records.join(labels.withColumnRenamed("quality", "label"), "doc_id", "left")
    return joined.withColumn("review_status", status_from_labels(F.col("label"), F.col("toxic"))).withColumn("pos", F.col("doc_id")).drop("label", "toxic")


def _letters(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9 .,]", " ")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model answer per conversation pair in one of twelve shapes, well-formed, repairable or hopeless."""
    pairs = conv_qa(spark, sf_dir)
    fields = F.concat(F.lit('"instruction":"'), _letters(F.col("instruction")), F.lit('","input":"","output":"'), _letters(F.col("output")), F.lit('"'))
    question = F.concat(F.lit('"instruction":"'), _letters(F.col("instruction")), F.lit('"'))
    answer = F.concat(F.lit('"output":"'), _letters(F.col("output")), F.lit('"'))
    j = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    shapes = (
        j('{"items":[{', fields, "}]}"),
        j("[{", fields, "}]"),
        j('{"data":[{', fields, "},{", question, "}]}"),
        j("Sure:\n```json\n{\"records\":[{", fields, "}]}\n```\nbye"),
        j('{"items":[{', fields, ",},]}"),
        F.replace(j('{"items":[{', fields, "}]}"), F.lit('"'), F.lit("'")),
        j("The data is {items: [{", fields, "}]} as asked"),
        j("no data ", _letters(F.col("output"))),
        j('{"items":[{', question, ',"input":null,', answer, "},{", question, ',"output":5},{"instruction":" ",', answer, "},{", question, ",", answer, ',"input":"x"}]}'),
        j("{", question, ",", answer, "}"),
        j("  \n "),
        j('```\n{"items": oops}\n```'),
    )
    shape = (F.col("conv_id") + F.col("turn")) % len(shapes)
    chosen = F.coalesce(*[F.when(shape == i, text) for i, text in enumerate(shapes)])
    return pairs.select("conv_id", "turn", chosen.alias("raw_content"))


def round_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round log per conversation, one line per pair; every third log has a broken second line."""
    pairs = conv_qa(spark, sf_dir)
    line = F.concat(
        F.lit('{"round":'),
        F.floor(F.col("turn") / 2 + 1).cast("string"),
        F.lit(',"items":[{"instruction":"'),
        _letters(F.col("instruction")),
        F.lit('","input":"","output":"'),
        _letters(F.col("output")),
        F.lit('"}],"finishReason":"length"}'),
    )
    broken = (F.col("conv_id") % 3 == 0) & (F.col("turn") >= 2) & (F.col("turn") < 4)
    return pairs.select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("line_no"), F.when(broken, F.lit('{"round": 2, "items"')).otherwise(line).alias("line")
    )


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round of one item per conversation pair, whole texts."""
    item = F.struct("instruction", "input", "output")
    return conv_qa(spark, sf_dir).select(
        F.col("conv_id").cast("string").alias("session_id"),
        F.floor(F.col("turn") / 2 + 1).cast("bigint").alias("round"),
        F.array(item).alias("items"),
        F.lit(1).cast("bigint").alias("valid_count"),
        F.when(F.col("turn") % 4 < 2, "length").otherwise("stop").alias("finish_reason"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run per document: creation and update times and a status."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("run_id"),
        F.concat("source", F.lit(".txt")).alias("file_name"),
        (F.col("doc_id") % 997 * 3_600_000).alias("created_at"),
        (F.col("doc_id") % 997 * 3_600_000 + F.col("n_chars")).alias("updated_at"),
        F.when(F.col("doc_id") % 4 == 0, "running").otherwise("completed").alias("status"),
        F.when(F.col("doc_id") % 7 == 0, "error").otherwise("done").alias("outcome"),
        (F.col("n_chars") % 50).alias("item_count"),
    )


def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("seq"),
        F.floor("value").cast("bigint").alias("done"),
        F.lit(1000).cast("bigint").alias("total"),
        (F.col("event_id") % 7).alias("total_items"),
    )
