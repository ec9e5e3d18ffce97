"""The queries that SQL can express, against it."""

import pytest
from oracle import same

from sparkloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir)
