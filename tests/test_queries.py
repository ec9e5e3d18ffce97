"""Every graph query against the SQL that gives the same rows."""

import pytest
from oracle import same

from sparkloom import queries, social

QUERIES, ORACLE_SQL = queries.QUERIES | social.QUERIES, queries.ORACLE_SQL | social.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE_SQL.keys()
