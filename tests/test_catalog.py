import pytest

from codestrata import catalog

from .parity import rows_of_query, rows_of_sql


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_its_oracle(spark, small, name):
    assert rows_of_query(catalog.QUERIES[name](spark, small)) == rows_of_sql(catalog.ORACLES[name], small)


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
