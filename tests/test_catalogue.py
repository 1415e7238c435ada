"""Every raster query against its oracle, or against its own schema where SQL has no form of it."""

import pytest

from orbitframe.plans import catalogue
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_oracle(spark, sf_dir, name):
    assert_same(spark, catalogue.QUERIES[name], catalogue.ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_gives_rows(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 70
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
