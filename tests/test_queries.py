import pytest

from paperloom.plans.queries import ORACLE_SQL, QUERIES
from sqlcheck import compare


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    compare(spark, QUERIES[name], ORACLE_SQL[name])
