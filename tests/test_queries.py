"""Every registered query beside its SQL, on the smallest data."""

import pytest

import __spark_entry__ as entry
import oracle

SF = "/root/testdata/sf0.001"
# at the smallest size no group passes the size gate of these queries
LARGER = "/root/testdata/sf0.01"
AT_LARGER = {"balanced_components", "duration_by_hour", "interviewer_attrition", "variance_components", "variance_shares"}
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return {sf: oracle.connect(sf) for sf in (SF, LARGER)}


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["source", "interviewer"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    sf = LARGER if name in AT_LARGER else SF
    df = QUERIES[name](spark, sf)
    if name in SQL:
        assert oracle.compare(df, con[sf], SQL[name]) == []
    else:
        assert df.count() > 0
