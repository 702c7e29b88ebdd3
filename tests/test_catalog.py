"""Every named query against its SQL, on the smallest driver tables."""

import pytest

from tests.conftest import duck, rows
from tessella.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLE:
        assert rows(got.toPandas()) == rows(con.sql(catalog.ORACLE[name]).df())
    else:
        assert got.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
