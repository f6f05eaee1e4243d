"""The SQL surface as named queries: table functions called with their parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame

from parcelrules.plans import views
from parcelrules.plans.registry import CHECK_SQL, Tables, query, rounded
from parcelrules.plans.suite_reports import EXP, TESTS
from parcelrules.sources import responses as src


def called(t: Tables, sql: str) -> DataFrame:
    views.register_functions(t.spark, t.experiments, t.tests, t.gt_documents, t.gt_requirements, t.zdocuments, t.jobs,
                             src.bulk_calls(t.spark, t.folder))
    return rounded(t.spark.sql(sql))


@query("call_best_prompts", CHECK_SQL["best_prompts"])
def call_best_prompts(t):
    return called(t, "SELECT * FROM best_prompts(5, 10)")


@query("call_statistics", f"""SELECT d.*, j.* FROM ({CHECK_SQL["document_stats"]}) d, ({CHECK_SQL["jobs_summary"]}) j""")
def call_statistics(t):
    return called(t, "SELECT * FROM document_stats() JOIN jobs_summary()")


@query("call_document_results", """SELECT id, document_name, prompt_name, prompt_version, test_epoch,
           round(overall_accuracy_score, 9) AS overall_accuracy, round(zone_identification_accuracy, 9) AS zone_accuracy,
           round(field_extraction_accuracy, 9) AS field_accuracy, parsed_zones_count AS zones_found, test_date
    FROM gt_documents d JOIN tests r ON r.ground_truth_doc_id = d.id
    JOIN (SELECT id AS eid, prompt_name, prompt_version FROM experiments) e ON eid = prompt_experiment_id""", (EXP, TESTS, "gt_documents"))
def call_document_results(t):
    t.gt_documents.createOrReplaceTempView("truth_documents")
    return called(t, "SELECT d.id, d.document_name, r.* FROM truth_documents d, LATERAL document_test_results(d.id) r")


@query("call_test_period", """SELECT count(DISTINCT prompt_experiment_id) AS tested_experiments, count(*) AS total_tests,
           round(avg(overall_accuracy_score), 9) AS avg_accuracy, count(DISTINCT ground_truth_doc_id) AS tested_documents
    FROM tests WHERE test_date BETWEEN TIMESTAMP '2001-08-01' AND TIMESTAMP '2001-11-05'""", (TESTS,))
def call_test_period(t):
    return called(t, "SELECT * FROM test_period(TIMESTAMP_NTZ '2001-08-01 00:00:00', TIMESTAMP_NTZ '2001-11-05 00:00:00')")


@query("call_bulk_results", f"""SELECT response_id, CASE WHEN success THEN
           '{{"success":true,"message":"' || message || '","inserted_count":' || inserted_count || ',"error_count":' || error_count
           || ',"town":"' || town || '","county":null}}'
           ELSE '{{"success":false,"message":"' || message || '"}}' END AS result
    FROM ({CHECK_SQL["upsert_report"]}) u""")
def call_bulk_results(t):
    return called(t, "SELECT * FROM bulk_results()")
