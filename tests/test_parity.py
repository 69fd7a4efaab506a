"""Every query with an oracle against DuckDB; every other query must return rows."""

import pytest

from codecorpus.plans import catalog
from codecorpus.plans.compare import compare, duck


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


# Nothing of these kinds occurs in the smallest data set.
EMPTY = {"f7_by_complexity", "w3_suspicious"}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, sf_dir, name):
    problem = compare(spark, con, sf_dir, name)
    assert problem is None or (problem == "no rows" and name in EMPTY), problem


def test_oracles_belong_to_queries():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
