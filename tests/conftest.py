"""One session for all tests."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from dispatchery.session import local_session

    session = local_session(partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def archive(spark):
    from dispatchery.sources.archive import Archive

    if not os.path.isdir(SMALL):
        pytest.skip("no test data")
    return Archive.at(spark, SMALL)


@pytest.fixture
def values(spark):
    """Evaluate a column function over literal inputs, in order."""
    def run(fn, inputs, kind="string"):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
        from pyspark.sql import functions as F

        got = rows.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()
        return [r["r"] for r in got]

    return run
