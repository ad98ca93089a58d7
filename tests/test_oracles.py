"""Every registered query runs; those with a SQL twin return the same rows."""

import pytest

from check_queries import difference, open_tables
from clickmill.plans import registry

SF_DIR = "/root/testdata/sf0.001"
registry.load_all()


@pytest.fixture(scope="module")
def tables():
    return open_tables(SF_DIR)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equal_to_sql(spark, tables, name):
    df = registry.QUERIES[name](spark, SF_DIR)
    assert difference(df, tables, registry.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_fitted_models_give_rows(spark, name):
    assert registry.QUERIES[name](spark, SF_DIR).count() > 0
