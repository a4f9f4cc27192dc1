"""Every registered query of the library against its SQL."""

from __future__ import annotations

import pytest

from tessera.plans import registry
from tests.oracle import connect, rows_of, rows_of_sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    found = rows_of(registry.QUERIES[name](spark, SF))
    if name in registry.ORACLE_SQL:
        assert found == rows_of_sql(db, registry.ORACLE_SQL[name])
    else:
        assert found[1]


def test_entry_has_all_queries():
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
