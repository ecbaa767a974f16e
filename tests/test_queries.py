import pytest

from parley import plans
from tests.oracle import same

SF = "/root/testdata/sf0.001"
#: Queries whose operators are held against plain versions elsewhere, and whose many jobs take long.
ELSEWHERE = {"density_hierarchy", "hybrid_clusters"}


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_matches_sql(spark, name):
    same(plans.queries()[name](spark, SF), plans.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql()) - ELSEWHERE))
def test_query_without_sql_runs(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
