"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import checks.all  # noqa: F401
from checks.compare import compare, tables
from checks.registry import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    return tables(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    wrong, _, _ = compare(spark, db, FOLDER, name)
    assert wrong is None, wrong
