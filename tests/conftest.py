import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from codecorpus.session import local_session

    session = local_session("codecorpus-tests", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture
def texts(spark):
    """One row per text: (file_id, language, content, path)."""

    def make(*rows, language="python"):
        full = [(i, *(r if isinstance(r, tuple) else (language, r))) for i, r in enumerate(rows)]
        df = spark.createDataFrame(full, "file_id bigint, language string, content string")
        return df.selectExpr("*", "concat('f', file_id) AS path")

    return make
