"""Registered queries that SQL can express, against it."""

import pytest

from skiplight.llm.queries import ORACLES, QUERIES
from tests.conftest import SF
from tests.oracle import agree, connect


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    agree(connect(SF), QUERIES[name](spark, SF), ORACLES[name])
