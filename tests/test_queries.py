"""Every registered query beside its SQL, on the smallest given tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from compare import compare, database

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return database(SF_DIR)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, db, name):
    problem, _, _, _ = compare(spark, db, SF_DIR, name)
    assert problem is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
