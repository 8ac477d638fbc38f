"""Every query of the library's own operators against DuckDB."""

import pytest

from tests.oracle import compare, duck
from tracelake.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql()) | set(registry._FOLDS)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, con, name):
    compare(spark, SF, registry.queries()[name], registry.oracle_sql()[name], con)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[0] == "conv_id"
