"""Every query with an SQL twin gives the twin's rows."""

import pytest
from conftest import normal

from emberlog import catalog

NAMES = sorted(catalog.queries())


@pytest.mark.parametrize("name", NAMES)
def test_twin(name, spark, data, duck):
    df = catalog.queries()[name](spark, data)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    sql = catalog.oracle_sql().get(name)
    if sql:
        assert got == duck(sql)
    else:
        assert got[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
