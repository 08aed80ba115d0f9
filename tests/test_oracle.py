import pytest

from leafmill.plans import file_queries  # noqa: F401 - registers its queries
from leafmill.plans.queries import QUERIES, SQL
from tests.conftest import SMALL
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert compare(spark, QUERIES[name], SQL[name], SMALL) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.columns and df.count() > 0
