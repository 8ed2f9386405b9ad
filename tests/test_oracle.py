"""Every query with SQL, on the smallest tables, against that SQL; the others run and have a stable schema."""

import pytest
from conftest import DATA

from skein.plans import reference, reference_sql, skewed

QUERIES = {**skewed.QUERIES, **reference.QUERIES}
SQL = {**skewed.SQL, **reference_sql.SQL}
pytestmark = pytest.mark.skipif(not (DATA / "sf0.001").exists(), reason="no test tables")


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(name, against_sql):
    against_sql(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_query_without_sql_runs(name, spark):
    df = QUERIES[name](spark, str(DATA / "sf0.001"))
    assert df.count() >= 0 and df.columns
