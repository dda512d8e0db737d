"""Every query against its SQL, and every other query for rows and a stable schema."""

import pytest

from quillspark import registry
from tests.compare import DATA, same

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    same(QUERIES[name](spark, str(DATA / "sf0.001")), SQL[name], DATA / "sf0.001")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, name):
    df = QUERIES[name](spark, str(DATA / "sf0.001"))
    assert df.columns and len(df.collect()) > 0
