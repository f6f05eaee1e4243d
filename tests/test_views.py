from parcelrules.plans import views
from parcelrules.plans.registry import Tables


def test_views_and_function(spark, folder):
    t = Tables(spark, folder)
    views.register(spark, t.experiments, t.tests, t.gt_documents, t.gt_requirements)
    assert spark.sql("SELECT prompt_name, success_rate FROM prompt_performance_summary").count() == t.experiments.count()
    total = spark.sql("SELECT sum(verified_zones) AS n FROM ground_truth_overview").first().n
    assert total == t.gt_requirements.count()
    row = spark.sql("SELECT field_accuracy(104, 100), field_accuracy(150, 100), field_accuracy(NULL, NULL), "
                    "field_accuracy(NULL, 1), field_accuracy(0, 0), field_accuracy(1, 0), field_accuracy(108, 100, 10)")
    assert tuple(row.first()) == (1.0, 0.5, 1.0, 0.0, 1.0, 0.0, 1.0)


def test_timeline_reads_the_facts_once(spark, folder):
    from parcelrules.plans import suite

    plan = suite.QUERIES["accuracy_timeline"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1
    assert "GreaterThanOrEqual(l_shipdate" in plan


def test_table_functions(spark, folder):
    """Arguments reach the scan, a function called per row becomes a join, and a result is one JSON object."""
    import json

    from parcelrules.plans import suite, suite_sql

    t = Tables(spark, folder)
    period = suite_sql.called(t, "SELECT * FROM test_period(TIMESTAMP_NTZ '2001-08-01 00:00:00', TIMESTAMP_NTZ '2001-08-03 00:00:00')")
    assert "LessThanOrEqual(l_shipdate" in period._jdf.queryExecution().executedPlan().toString()
    plan = suite.QUERIES["call_document_results"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and plan.count("lineitem.parquet") == 1
    few = suite_sql.called(t, "SELECT * FROM best_prompts(min_tests => 1, how_many => 3)").collect()
    assert len(few) == 3 and suite_sql.called(t, "SELECT * FROM best_prompts(1000000000)").count() == 0
    for row in suite_sql.called(t, "SELECT * FROM bulk_results()").collect():
        said = json.loads(row.result)
        assert set(said) == ({"success", "message", "inserted_count", "error_count", "town", "county"} if said["success"] else {"success", "message"})
