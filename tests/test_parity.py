"""Every query of the reference's own operators against its DuckDB twin at sf0.01 (the driver's
correctness gate), compared order-insensitively after sorting columns."""

import pytest

from conftest import SF_CHECK
from tools.parity import duck, rows_of

import __spark_entry__ as E
from ledgerlake.plans.registry import oracle_sql, spark_queries

QUERIES = spark_queries()
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_CHECK)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_CHECK)
    got = [tuple(r) for r in df.collect()]
    res = con.execute(SQL[name])
    exp_cols = [d[0] for d in res.description]
    exp = res.fetchall()
    a, ac = rows_of(df.columns, got)
    b, bc = rows_of(exp_cols, exp)
    assert ac == bc
    assert len(a) == len(b)
    assert a == b


def test_every_query_has_a_twin_and_is_registered():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:2] == ["account_id", "as_of_date"]
