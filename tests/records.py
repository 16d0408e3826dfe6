"""Hand-made review records."""

from pyspark.sql import functions as F

SCHEMA = (
    "pos bigint, id string, instruction string, input string, output string, overall double, document string, heading string, "
    "review_status string, file_name string"
)


def make_records(rows, data):
    """Records with every score equal to ``overall``."""
    filled = [
        {"pos": i, "id": f"r{i}", "input": "", "overall": 0.9, "document": "doc", "review_status": "pending", "file_name": "notes.md", **d}
        for i, d in enumerate(data)
    ]
    scores = [F.col("overall").alias(n) for n in ("groundedness", "completeness", "clarity", "relevance", "overall")]
    source = F.struct(
        F.col("document").alias("document_id"),
        "file_name",
        F.lit("md").alias("file_type"),
        F.col("id").alias("chunk_id"),
        "heading",
        F.lit(0).cast("bigint").alias("start_offset"),
        F.length("output").cast("bigint").alias("end_offset"),
        F.col("output").alias("text"),
        F.lit(True).alias("available"),
    )
    return rows(filled, SCHEMA).select(
        "pos", "id", "instruction", "input", "output", "document", "review_status",
        F.struct(*scores, F.array().cast("array<string>").alias("flags")).alias("quality"),
        source.alias("source"),
        F.lit("closed_book_qa").alias("task_type"),
        F.col("pos").alias("created_at"),
    )
