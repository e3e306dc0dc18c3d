"""Every registered query of the engine against independent SQL."""

import pytest

from tests.oracle import rows_of, same
from tidemark import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, sf_dir, name):
    same(registry.queries()[name](spark, sf_dir).toPandas(), rows_of(SQL[name], sf_dir))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
