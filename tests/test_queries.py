import pytest

from shelfline.registry import ORACLE_SQL, QUERIES

from .oracle import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    assert differences(spark, connect(SF), name, QUERIES[name], ORACLE_SQL[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0
