"""The driver contract: names, keys, schemas and the flagship."""

import __spark_entry__ as entry


def test_every_check_has_a_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(0 <= r["overall"] <= 100 and r["passed"] + r["failed"] == r["total"] for r in rows)


def test_no_cross_products_in_the_flagship(spark, small):
    from reviewtrust.plans.trust import analyze
    from reviewtrust.sources import tables as T

    df = analyze(T.reviews(spark, small), T.products(spark, small), T.evidence(spark, small))
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
