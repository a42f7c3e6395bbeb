"""Registered queries against their SQL."""

import pytest
from oracle import SF, differences

from spanloom.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, name):
    if name in Q.SQL:
        _, wrong = differences(spark, Q.QUERIES[name], Q.SQL[name])
        assert not wrong
    else:
        assert Q.QUERIES[name](spark, SF).count() > 0
