"""What SQL users get: the standing views, the field accuracy function and table functions with parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parcelrules import fixed_values as fv
from parcelrules.operators import responses, stats
from parcelrules.plans import reports

FIELD_ACCURACY = f"""
    CREATE OR REPLACE TEMPORARY FUNCTION field_accuracy(
        predicted DOUBLE, actual DOUBLE, tolerance DOUBLE DEFAULT {fv.FIELD_TOLERANCE_PERCENT}D)
    RETURNS DOUBLE
    RETURN CASE WHEN predicted IS NULL AND actual IS NULL THEN 1.0D
                WHEN predicted IS NULL OR actual IS NULL THEN 0.0D
                WHEN actual = 0 THEN CAST(predicted = 0 AS INT)
                WHEN abs(try_divide(predicted - actual, actual)) * 100 <= tolerance THEN 1.0D
                ELSE greatest(0.0D, 1 - abs(try_divide(predicted - actual, actual))) END"""


def register(spark: SparkSession, experiments: DataFrame, tests: DataFrame, gt_documents: DataFrame,
             gt_requirements: DataFrame) -> None:
    """Temporary views over the given tables; sorting is left to the reader."""
    spark.sql(FIELD_ACCURACY)
    refreshed = stats.experiment_stats(experiments, tests)
    reports.prompt_performance(refreshed).createOrReplaceTempView("prompt_performance_summary")
    stats.ground_truth_overview(gt_documents, gt_requirements).createOrReplaceTempView("ground_truth_overview")


# Table functions over the views of ``register_functions``. Arguments are part of the plan, so filters reach the scans.
_PERIOD = "test_date BETWEEN first AND last OR test_date IS NULL"
TABLE_FUNCTIONS = {
    "document_stats()": "SELECT * FROM zoning_document_stats",
    "jobs_summary()": "SELECT * FROM zoning_jobs_summary",
    "best_prompts(min_tests INT DEFAULT 5, how_many INT DEFAULT 10)": """
        SELECT prompt_name, prompt_version, llm_model, total_tests, success_rate, average_accuracy_score AS avg_accuracy,
               average_field_accuracy AS avg_field_accuracy, average_zone_accuracy AS avg_zone_accuracy, last_tested_at AS last_tested
        FROM (SELECT *, row_number() OVER (ORDER BY average_accuracy_score DESC NULLS LAST, total_tests DESC, id) AS place
              FROM prompt_performance_summary WHERE total_tests >= min_tests) WHERE place <= how_many""",
    "document_test_results(document BIGINT)": """
        SELECT prompt_name, prompt_version, test_epoch, overall_accuracy, zone_accuracy, field_accuracy, zones_found, test_date
        FROM document_results WHERE ground_truth_doc_id = document""",
    "test_period(first TIMESTAMP_NTZ, last TIMESTAMP_NTZ)": f"""
        SELECT count(DISTINCT prompt_experiment_id) AS tested_experiments, count(*) AS total_tests,
               avg(overall_accuracy_score) AS avg_accuracy, count(DISTINCT ground_truth_doc_id) AS tested_documents
        FROM prompt_tests WHERE {_PERIOD}""",
    "bulk_results()": "SELECT response_id, bulk_result(success, message, inserted_count, error_count, town, county) AS result FROM bulk_reports",
}

BULK_RESULT = """
    CREATE OR REPLACE TEMPORARY FUNCTION bulk_result(
        success BOOLEAN, message STRING, inserted BIGINT, errors BIGINT, town STRING, county STRING)
    RETURNS STRING
    RETURN CASE WHEN success THEN to_json(named_struct('success', success, 'message', message, 'inserted_count', inserted,
                                                       'error_count', errors, 'town', town, 'county', county),
                                          map('ignoreNullFields', 'false'))
                ELSE to_json(named_struct('success', success, 'message', message)) END"""


def register_functions(spark: SparkSession, experiments: DataFrame, tests: DataFrame, gt_documents: DataFrame, gt_requirements: DataFrame,
                       documents: DataFrame, jobs: DataFrame, calls: DataFrame) -> None:
    """The views of :func:`register`, those the table functions read, and the functions. Registered again, they read the tables given last."""
    register(spark, experiments, tests, gt_documents, gt_requirements)
    for name, rows in {"zoning_document_stats": stats.document_stats(documents), "zoning_jobs_summary": stats.jobs_summary(jobs),
                       "document_results": stats.document_test_results(tests, experiments), "prompt_tests": tests,
                       "bulk_reports": responses.bulk_report(calls)}.items():
        rows.createOrReplaceTempView(name)
    spark.sql(BULK_RESULT)
    for head, body in TABLE_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS TABLE RETURN {body}")
