"""Every query with SQL gives the same rows as DuckDB; the others run."""

import os

import pytest

import __spark_entry__ as entry
from tests import oracle

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables absent")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    *_, problems = oracle.compare(spark, con, name, SF_DIR, QUERIES, ORACLES)
    assert [p for p in problems if p != "no SQL"] == []


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["qid", "rank", "chunk_id", "score"] and df.count() > 0
