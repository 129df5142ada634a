"""Operators that SQL can express, against it."""

import pytest

from sumforge.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import connection, differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    assert differences(QUERIES[name](spark, SF), connection(SF), ORACLE_SQL[name]) == []
