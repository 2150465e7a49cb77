"""Queries that SQL can express, over the test tables."""

import pytest

from tandem.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, same):
    same(QUERIES[name], ORACLES[name])


def test_every_operator_has_a_query():
    assert {int(k[2:].split("_")[0]) for k in QUERIES} == set(range(1, 14))
