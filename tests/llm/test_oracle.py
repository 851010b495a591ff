"""Queries of the training-data operators that SQL can express, against it."""

import pytest

from lodeweave.llm import queries as llm

SQL = llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, same):
    same(llm.queries()[name], SQL[name])
