"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check import compare, connect
from tests.conftest import DATA

NAMES = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, con, name):
    line = compare(spark, con, name, DATA)
    assert line.startswith("ok"), line
    assert " types " not in line


def test_entry_is_lazy_and_stable(spark):
    df = entry.entry(spark)
    assert df.columns == ["restaurant", "dish", "total"]
    assert df.count() == 20
