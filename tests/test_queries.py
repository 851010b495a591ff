"""Every registered query of the engine against its SQL."""

import pytest

from lodeweave import queries as engine

QUERIES, SQL = engine.queries(), engine.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(name, same):
    assert name in SQL
    same(QUERIES[name], SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
