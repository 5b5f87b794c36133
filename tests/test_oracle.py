"""Every registered query: equal to its SQL where there is SQL, otherwise some rows."""

import oracle
import pytest

from strucreg import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.connect(sf_dir)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, duck, name):
    assert oracle.differences(QUERIES[name](spark, sf_dir), duck, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).collect()
    assert rows and all(v is not None for r in rows for v in r)
