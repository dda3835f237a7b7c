"""Every registered query with SQL gives the SQL's rows; the others run and have rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import canonical, connect, oracle
from streetgrid.plans import catalogue


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, con, name):
    found = catalogue.QUERIES[name](spark, sf_dir)
    if name in catalogue.ORACLE_SQL:
        assert canonical(found.toPandas()) == canonical(oracle(con, catalogue.ORACLE_SQL[name]))
    else:
        assert found.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert isinstance(duckdb.__version__, str)
