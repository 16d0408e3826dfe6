"""Registered queries against their SQL on rows that the given tables lack."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as spec
from quillset.sources import files

SF_DIR = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# No text, no sentence, one sentence, several.
TEXTS = (None, "", " \n", "...", "?!\n.", "one", "one. two, three. four")


@pytest.fixture
def folder(spark, tmp_path):
    """The smallest tables, with odd documents after the given ones."""
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = [(10_000 + i, text, "en", "odd", len(text or "")) for i, text in enumerate(TEXTS * 3)]
    given.unionByName(spark.createDataFrame(odd, DOCUMENTS)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF_DIR}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def assert_equals_sql(spark, name, folder):
    db = duckdb.connect()
    for table in os.listdir(folder):
        db.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{table}/*.parquet'")
    df = spec.queries()[name](spark, folder)
    columns = sorted(df.columns)
    expected = db.sql(spec.oracle_sql()[name]).select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()
    assert Counter(tuple(r) for r in df.select(*columns).collect()) == Counter(expected)


def test_facets_over_documents_without_a_sentence(spark, folder):
    assert_equals_sql(spark, "facet_filter", folder)


def test_guard_rejects_every_fifth_document_only(spark, folder):
    assert_equals_sql(spark, "empty_document_guard", folder)


def test_guard_itself_rejects_all_blank_texts(spark):
    docs = spark.createDataFrame([(i, text) for i, text in enumerate(TEXTS)], "doc_id bigint, text string")
    kept, refused = files.reject_empty(docs)
    assert {r["doc_id"] for r in refused.collect()} == {0, 1, 2} and kept.count() == len(TEXTS) - 3


def test_one_of_several_copies_is_restored(spark, tmp_path):
    # Copies within one conversation share their id; of those absorbed (2, 4, 6) only position 6 is asked for.
    turns = [(0, turn, ("user", "assistant")[turn % 2], ("how is it set?", "by the dial")[turn % 2]) for turn in range(8)]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert_equals_sql(spark, "restore_duplicate", str(tmp_path))
