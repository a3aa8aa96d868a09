"""Every registered query beside its SQL on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from compare import connect, differences

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="tables not at hand")


@pytest.fixture(scope="module")
def sql():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_agrees_with_sql(spark, sql, name):
    assert differences(spark, sql, SF, entry.queries()[name], entry.oracle_sql()[name]) == []


def test_only_training_data_queries_may_lack_sql():
    lacking = set(entry.queries()) - set(entry.oracle_sql())
    assert all(name == "pipeline" or name.startswith("op") for name in lacking)


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
