import pytest

import __spark_entry__ as entries
from compare import differences
from conftest import SF

# the queries of the training-data operators have their own tests
QUERIES = {n: q for n, q in entries.queries().items() if not n.startswith("op") and n != "pipeline"}
ORACLE = {n: sql for n, sql in entries.oracle_sql().items() if n in QUERIES}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    df = QUERIES[name](spark, SF)
    assert differences(df, SF, ORACLE[name]) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entries.entry(spark).count() > 0
