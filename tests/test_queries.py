import pytest
from oracle import SF, assert_same

from plume import jobs


@pytest.mark.parametrize("name", sorted(jobs.ORACLE))
def test_query_equals_sql(spark, name):
    assert_same(spark, jobs.QUERIES[name], jobs.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(jobs.QUERIES) - set(jobs.ORACLE)))
def test_other_queries_have_rows(spark, name):
    assert jobs.QUERIES[name](spark, SF).limit(1).count() == 1
