import pytest

from marlstone.plans import registry
from tests.compare import check

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, name):
    check(spark, "/root/testdata/sf0.001", registry.queries()[name], SQL[name])


def test_every_query_is_registered():
    assert set(SQL) <= set(registry.queries())
