import pytest
from helpers import SF, oracle, rows_of

from rasterflow import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, name):
    assert rows_of(registry.QUERIES[name](spark, SF)) == oracle(registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.count() == (1 if name == "png_encode" else 1000)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
