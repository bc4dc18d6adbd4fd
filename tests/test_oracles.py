"""Every registered query with an oracle agrees with DuckDB on the smallest data set."""

import pytest

import __spark_entry__ as E
from tests.oracle_check import duck, rows_of
from tests.conftest import SMALL

SQL = E.oracle_sql()
SLOW = {"communities_louvain", "communities_lp"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, name):
    df = E.queries()[name](spark, SMALL)
    a, ac = rows_of(df.columns, [tuple(r) for r in df.collect()])
    b, bc = rows_of(*duck(SMALL, SQL[name]))
    assert ac == bc
    assert a == b


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["tag", "freq"] and len(rows) > 0
