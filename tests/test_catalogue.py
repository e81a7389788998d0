import pytest

import __spark_entry__ as entry
from voxframe.plans import catalogue

from oracle import compare


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    compare(spark, sf_dir, catalogue.QUERIES[name], catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    first = entry.entry(spark)
    assert first.columns[0] == "rec" and first.count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
