import pytest


@pytest.fixture
def docs(spark):
    """Documents with an extra column whose name the operators might use themselves."""

    def make(texts, ids=None):
        rows = [(i, t, "x", 1) for i, t in zip(ids if ids is not None else range(len(texts)), texts)]
        return spark.createDataFrame(rows, "doc_id bigint, text string, row string, count int")

    return make


#: Null, empty, white space only, repeated, very long, and characters beyond ASCII.
AWKWARD = [None, "", " \n\t ", "one", "one", "a b c " * 3000, "x" * 100_000, "Ünïcode \u00a0 \u2028 ΑΣ İ 日本語 👍🏽 \x1c", "the end.\n\nthe end.\n"]
