import math

import pytest

import __spark_entry__ as entry
from shardloom.catalog import queries as catalog
from tools.compare import compare, connect

SF = "/root/testdata/sf0.001"


OWN = sorted(catalog.queries())


def test_every_query_has_sql_and_no_stray_sql():
    assert set(OWN) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    row = entry.entry(spark).first().asDict()
    assert len(row) == 10 and not any(math.isnan(v) for v in row.values())


@pytest.mark.parametrize("name", OWN)
def test_query_equals_its_sql(spark, name):
    ok, note = compare(spark, connect(SF), entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, note
