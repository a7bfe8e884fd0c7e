"""Every query of the library's own operators against its SQL twin, and the entry points."""

import pytest

from columnscout.plans import registry
from tests.oracle import check

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, small, name):
    check(spark, small, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, small, name):
    frame = QUERIES[name](spark, small).toPandas()
    assert len(frame.columns)


def test_entry(spark, small):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    keys = {(r.field_a, r.field_b) for r in e.entry(spark).collect()}
    assert ("l_orderkey", "o_orderkey") in keys and not any("c_acctbal" in k for k in keys)
