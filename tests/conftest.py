import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quillset.session import build_session

    session = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def rows(spark):
    """Build a DataFrame from a list of dicts and a DDL schema."""
    from pyspark.sql import Row

    def make(data, schema):
        names = [f.split(" ")[0].strip() for f in schema.split(", ")]
        return spark.createDataFrame([Row(*[d.get(n) for n in names]) for d in data], schema)

    return make
