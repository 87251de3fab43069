"""Every catalogue query against its SQL."""

import pytest

import __spark_entry__
from shutterlake.catalogue import ORACLE, QUERIES
from tests.oracle import differences

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    assert differences(QUERIES[name](spark, SMALL), SMALL, ORACLE[name]) == ""


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_every_catalogue_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", ["location_memories", "memory_titles", "stream_quiet_batches", "category_rollup"])
def test_rows_are_there_to_compare(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0
