"""Every catalog query against its DuckDB oracle on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from catalog.base import ORACLE, QUERIES  # noqa: E402
from tools.compare import compare, connect  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    result = compare(spark, db, SF, name, QUERIES[name], ORACLE.get(name))
    spark.catalog.clearCache()
    assert result == "ok" or (name not in ORACLE and result.startswith("rows"))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
