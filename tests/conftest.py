import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from repostrata.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "repostrata-tests")


@pytest.fixture
def column(spark):
    """Values of a column expression over one-column string rows, in order."""
    from pyspark.sql import functions as F

    def run(build, values):
        rows = [(i, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, "i int, s string").select("i", build(F.col("s")).alias("out"))
        return [
            r["out"] for r in sorted(df.collect(), key=lambda r: r["i"])
        ]

    return run


@pytest.fixture
def files(spark):
    """(repo, path, content) rows as a files table."""

    def make(rows):
        full = [(r, p, len(c.encode()), c) for r, p, c in rows]
        return spark.createDataFrame(full, "repo_id string, path string, size_bytes long, content string")

    return make
