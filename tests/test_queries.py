"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as entry_module

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_matches_sql(spark, con, name):
    df = entry_module.queries()[name](spark, FOLDER)
    assert compare(df, con, entry_module.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(entry_module.queries()) - set(entry_module.oracle_sql())))
def test_runs(spark, name):
    assert entry_module.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["thr", "tp", "fp", "tpr", "fpr"]
