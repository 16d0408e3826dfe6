"""A few registered queries against DuckDB at the smallest scale; ``tools/check_oracles.py`` compares all of them."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as spec

SF_DIR = "/root/testdata/sf0.001"
CHECKED = ("chunks", "quality_scores", "near_dedup", "legacy_dedup", "search_hybrid", "parse_counts", "best_page_records")


def test_every_query_has_sql():
    from quillset.plans.oracles import ORACLES
    from quillset.plans.registry import QUERIES

    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(spec.queries()) and set(ORACLES) <= set(spec.oracle_sql()) <= set(spec.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "conversations", "labels", "events"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    df = spec.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    want = db.sql(spec.oracle_sql()[name])
    assert sorted(want.columns) == columns
    expected = Counter(want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
    assert Counter(tuple(r) for r in df.select(*columns).collect()) == expected
