"""Statistics, rankings, reports and listings as named queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from parcelrules.operators import search, stats
from parcelrules.plans import reports
from parcelrules.plans.registry import query, rounded

AS_OF = "2001-11-05"
EXP, TESTS, GTD, GTR, TZR = "experiments", "tests", "gt_documents", "gt_requirements", "zone_results"


def sql_percent(x: str) -> str:
    """One decimal, halves up."""
    tenths = f"CAST(floor(round({x}, 9) * 1000 + 0.5) AS BIGINT)"
    return f"(CAST({tenths} // 10 AS VARCHAR) || '.' || CAST({tenths} % 10 AS VARCHAR) || '%')"


# Experiments with their statistics, as the check derives them.
STATS_SQL = """
    rollup AS (SELECT prompt_experiment_id AS id, count(*) AS n, count(*) FILTER (WHERE extraction_success) AS ok,
                      count(*) FILTER (WHERE NOT extraction_success) AS bad, avg(overall_accuracy_score) AS acc,
                      avg(field_extraction_accuracy) AS facc, avg(zone_identification_accuracy) AS zacc,
                      max(test_date) AS last_at
               FROM tests GROUP BY 1),
    stats AS (SELECT e.*, coalesce(n, 0) AS total_tests, coalesce(ok, 0) AS successful_extractions,
                     coalesce(bad, 0) AS failed_extractions, coalesce(acc, 0.0) AS average_accuracy_score,
                     coalesce(facc, 0.0) AS average_field_accuracy, coalesce(zacc, 0.0) AS average_zone_accuracy,
                     last_at AS last_tested_at
              FROM experiments e LEFT JOIN rollup USING (id))"""
STATS_COLUMNS = """id, prompt_name, prompt_version, llm_model, is_baseline, is_active, created_at, total_tests,
    successful_extractions, failed_extractions, round(average_accuracy_score, 9) AS average_accuracy_score,
    round(average_field_accuracy, 9) AS average_field_accuracy,
    round(average_zone_accuracy, 9) AS average_zone_accuracy, last_tested_at"""


def _stats(t):
    return stats.experiment_stats(t.experiments, t.tests)


@query("experiment_stats", f"WITH {STATS_SQL} SELECT {STATS_COLUMNS} FROM stats", (EXP, TESTS))
def experiment_stats(t):
    return rounded(_stats(t))


@query("prompt_performance", f"""WITH {STATS_SQL}
    SELECT {STATS_COLUMNS}, round(CASE WHEN total_tests > 0 THEN successful_extractions / total_tests ELSE 0 END, 9)
        AS success_rate
    FROM stats""", (EXP, TESTS))
def prompt_performance(t):
    # Ranked when read: the operator and the view have no order.
    return rounded(reports.prompt_performance(_stats(t))).orderBy(
        F.desc_nulls_first("average_accuracy_score"), F.desc_nulls_first("created_at"), "id")


@query("dashboard_results", f"""WITH {STATS_SQL}
    SELECT prompt_name || ' v' || prompt_version AS prompt, llm_model, total_tests,
           {sql_percent('average_accuracy_score')} AS accuracy_text,
           CASE WHEN round(average_accuracy_score, 9) >= 0.9 THEN 'success' WHEN round(average_accuracy_score, 9) >= 0.7 THEN 'warning'
                ELSE 'error' END AS accuracy_band,
           CASE WHEN round(average_field_accuracy, 9) >= 0.9 THEN 'success' WHEN round(average_field_accuracy, 9) >= 0.7 THEN 'warning'
                ELSE 'error' END AS field_band,
           CASE WHEN round(average_zone_accuracy, 9) >= 0.9 THEN 'success' WHEN round(average_zone_accuracy, 9) >= 0.7 THEN 'warning'
                ELSE 'error' END AS zone_band,
           CASE WHEN total_tests > 0 THEN {sql_percent('successful_extractions / total_tests')} ELSE 'N/A' END
               AS success_text
    FROM stats""", (EXP, TESTS))
def dashboard_results(t):
    return reports.dashboard_results(_stats(t))


@query("best_prompts", f"""WITH {STATS_SQL}
    SELECT prompt_name, prompt_version, llm_model, total_tests,
           round(successful_extractions / total_tests, 9) AS success_rate,
           round(average_accuracy_score, 9) AS avg_accuracy, round(average_field_accuracy, 9) AS avg_field_accuracy,
           round(average_zone_accuracy, 9) AS avg_zone_accuracy, last_tested_at AS last_tested
    FROM stats WHERE total_tests >= 5
    ORDER BY average_accuracy_score DESC NULLS LAST, total_tests DESC, id LIMIT 10""", (EXP, TESTS))
def best_prompts(t):
    return rounded(stats.best_prompts(_stats(t)))


@query("active_experiments", f"""WITH {STATS_SQL}
    SELECT {STATS_COLUMNS} FROM stats WHERE is_active""", (EXP, TESTS))
def active_experiments(t):
    return rounded(search.active_experiments(_stats(t)))


@query("experiment_results", """
    SELECT e.id, prompt_name, prompt_version, count(prompt_experiment_id) AS total_tests,
           round(coalesce(avg(overall_accuracy_score), 0), 9) AS average_accuracy
    FROM experiments e LEFT JOIN tests ON prompt_experiment_id = e.id GROUP BY 1, 2, 3""", (EXP, TESTS))
def experiment_results(t):
    return rounded(stats.experiment_results(t.experiments, t.tests))


@query("document_test_results", """
    SELECT ground_truth_doc_id, prompt_name, prompt_version, test_epoch, round(overall_accuracy_score, 9)
           AS overall_accuracy, round(zone_identification_accuracy, 9) AS zone_accuracy,
           round(field_extraction_accuracy, 9) AS field_accuracy, parsed_zones_count AS zones_found, test_date
    FROM tests JOIN experiments e ON prompt_experiment_id = e.id""", (EXP, TESTS))
def document_test_results(t):
    return rounded(stats.document_test_results(t.tests, t.experiments))


@query("test_summary", f"""WITH {STATS_SQL},
    j AS (SELECT s.id, s.average_accuracy_score, r.overall_accuracy_score, r.prompt_experiment_id
          FROM stats s LEFT JOIN tests r ON s.id = r.prompt_experiment_id
          WHERE r.test_date BETWEEN TIMESTAMP '2001-08-01' AND TIMESTAMP '2001-11-05' OR r.test_date IS NULL),
    b AS (SELECT average_accuracy_score AS base FROM stats WHERE is_baseline ORDER BY created_at DESC, id DESC LIMIT 1)
    SELECT count(DISTINCT id) AS total_experiments, count(prompt_experiment_id) AS total_tests,
           round(avg(overall_accuracy_score), 9) AS avg_accuracy,
           (SELECT prompt_name || ' v' || prompt_version FROM stats WHERE total_tests >= 3
            ORDER BY average_accuracy_score DESC, id LIMIT 1) AS best_prompt,
           round(CASE WHEN (SELECT base FROM b) > 0
                      THEN (max(average_accuracy_score) - (SELECT base FROM b)) / (SELECT base FROM b) * 100
                      ELSE 0 END, 9) AS improvement_over_baseline
    FROM j""", (EXP, TESTS))
def test_summary(t):
    return rounded(stats.test_summary(t.experiments, t.tests, datetime(2001, 8, 1), datetime(2001, 11, 5)))


@query("improvement_over_baseline", """
    SELECT prompt_experiment_id, ground_truth_doc_id, test_epoch, test_date,
           round(overall_accuracy_score - coalesce((SELECT avg(r.overall_accuracy_score) FROM tests r
               JOIN experiments e ON r.prompt_experiment_id = e.id WHERE e.is_baseline), 0), 9)
           AS improvement_over_baseline
    FROM tests""", (EXP, TESTS))
def improvement_over_baseline(t):
    rows = reports.with_baseline_delta(t.tests, t.tests, t.experiments)
    return rounded(rows.select("prompt_experiment_id", "ground_truth_doc_id", "test_epoch", "test_date",
                               "improvement_over_baseline"))


@query("tests_last_n_days", """
    SELECT prompt_experiment_id, ground_truth_doc_id, test_epoch, test_date,
           round(overall_accuracy_score, 9) AS overall_accuracy_score
    FROM tests WHERE test_date BETWEEN TIMESTAMP '2001-08-07' AND TIMESTAMP '2001-11-05'""", (TESTS,))
def tests_last_n_days(t):
    rows = search.tests_last_n_days(t.tests, AS_OF, 90)
    return rounded(rows.select("prompt_experiment_id", "ground_truth_doc_id", "test_epoch", "test_date",
                               "overall_accuracy_score"))


@query("test_results_export", """
    SELECT test_epoch, strftime(test_date, '%Y-%m-%d %H:%M:%S') AS test_date,
           round(overall_accuracy_score, 9) AS overall_accuracy_score,
           round(zone_identification_accuracy, 9) AS zone_identification_accuracy,
           round(field_extraction_accuracy, 9) AS field_extraction_accuracy,
           round(location_extraction_accuracy, 9) AS location_extraction_accuracy, parsed_zones_count,
           extraction_success, round(processing_time_seconds, 9) AS processing_time_seconds, llm_tokens_used,
           prompt_name, prompt_version, llm_model, is_baseline, document_name, d.town, d.county, d.state,
           document_complexity,
           round(overall_accuracy_score - coalesce((SELECT avg(r.overall_accuracy_score) FROM tests r
               JOIN experiments b ON r.prompt_experiment_id = b.id WHERE b.is_baseline), 0), 9)
           AS improvement_over_baseline,
           CASE WHEN round(overall_accuracy_score, 9) >= 0.9 THEN 'Excellent' WHEN round(overall_accuracy_score, 9) >= 0.7 THEN 'Good'
                ELSE 'Needs Improvement' END AS accuracy_category,
           CASE WHEN round(zone_identification_accuracy, 9) >= 0.95 THEN 'Perfect'
                WHEN round(zone_identification_accuracy, 9) >= 0.8 THEN 'Good' ELSE 'Poor' END AS zone_extraction_category
    FROM tests LEFT JOIN experiments e ON prompt_experiment_id = e.id
         LEFT JOIN gt_documents d ON ground_truth_doc_id = d.id
    WHERE test_date BETWEEN TIMESTAMP '2001-08-07' AND TIMESTAMP '2001-11-05'""", (EXP, TESTS, GTD))
def test_results_export(t):
    return rounded(reports.test_results_export(t.tests, t.experiments, t.gt_documents, AS_OF, 90))


@query("accuracy_trends", """
    WITH d AS (
      SELECT CAST(test_date AS DATE) AS day, prompt_name, prompt_version, llm_model,
             avg(overall_accuracy_score) AS a, avg(zone_identification_accuracy) AS z,
             avg(field_extraction_accuracy) AS f, count(*) AS n,
             sum(CASE WHEN extraction_success THEN 1 ELSE 0 END) AS ok, avg(processing_time_seconds) AS p,
             avg(llm_tokens_used) AS k
      FROM tests JOIN experiments e ON prompt_experiment_id = e.id
      WHERE test_date >= DATE '2001-11-05' - INTERVAL 90 DAY GROUP BY 1, 2, 3, 4)
    SELECT strftime(day, '%Y-%m-%d') AS test_date, prompt_name, prompt_version, llm_model,
           round(a, 9) AS daily_avg_accuracy, round(z, 9) AS daily_avg_zone_accuracy,
           round(f, 9) AS daily_avg_field_accuracy, round(p, 9) AS avg_processing_time,
           round(k, 9) AS avg_tokens_used, n AS tests_per_day, CAST(ok AS BIGINT) AS successful_tests,
           round(a - lag(a) OVER (PARTITION BY prompt_name, prompt_version ORDER BY day DESC, a DESC, llm_model), 9)
               AS accuracy_trend,
           round(a - lag(a) OVER (PARTITION BY prompt_name, prompt_version ORDER BY day, a, llm_model DESC), 9)
               AS accuracy_change,
           CASE WHEN round(a, 9) >= 0.95 THEN 5 WHEN round(a, 9) >= 0.85 THEN 4 WHEN round(a, 9) >= 0.75 THEN 3 WHEN round(a, 9) >= 0.6 THEN 2 ELSE 1 END
               AS performance_rating
    FROM d""", (EXP, TESTS))
def accuracy_trends(t):
    return rounded(reports.accuracy_trends(t.tests, t.experiments, AS_OF))


@query("accuracy_timeline", """
    WITH d AS (
      SELECT CAST(test_date AS DATE) AS day, prompt_name, prompt_version, is_baseline,
             avg(overall_accuracy_score) AS a, avg(zone_identification_accuracy) AS z,
             avg(field_extraction_accuracy) AS f, count(*) AS n
      FROM tests JOIN experiments e ON prompt_experiment_id = e.id
      WHERE test_date >= DATE '2001-11-05' - INTERVAL 90 DAY GROUP BY 1, 2, 3, 4),
    b AS (SELECT day, avg(a) AS base FROM d WHERE is_baseline GROUP BY 1),
    l AS (SELECT d.*, base, lag(a) OVER (PARTITION BY prompt_name, prompt_version ORDER BY d.day) AS prev
          FROM d LEFT JOIN b ON d.day = b.day)
    SELECT strftime(day, '%Y-%m-%d') AS test_date, prompt_name, prompt_version, is_baseline,
           round(a, 9) AS daily_accuracy, round(z, 9) AS daily_zone_accuracy, round(f, 9) AS daily_field_accuracy,
           n AS daily_tests, round(base, 9) AS baseline_accuracy,
           round(a - coalesce(base, 0), 9) AS improvement_over_baseline, round(prev, 9) AS previous_day_accuracy,
           round(a - prev, 9) AS day_over_day_change, prompt_name || ' v' || prompt_version AS prompt_full_name,
           CASE WHEN prev IS NULL THEN 'New' WHEN round(a - prev, 9) > 0.01 THEN 'Improving' WHEN round(a - prev, 9) < -0.01
                THEN 'Declining' ELSE 'Stable' END AS trend_direction
    FROM l""", (EXP, TESTS))
def accuracy_timeline(t):
    return rounded(reports.accuracy_timeline(t.tests, t.experiments, AS_OF))


def _relative(p: str, a: str) -> str:
    return f"round(CASE WHEN {a} <> 0 THEN abs(1 - abs({p} - {a}) / {a}) END, 9)"


@query("field_accuracy_heatmap", f"""
    SELECT prompt_name, prompt_version, predicted_zone, actual_zone,
           {_relative('predicted_interior_min_lot_area_sqft', 'interior_min_lot_area_sqft')} AS lot_area_accuracy,
           {_relative('predicted_principal_front_yard_ft', 'principal_front_yard_ft')} AS front_yard_accuracy,
           {_relative('predicted_principal_side_yard_ft', 'principal_side_yard_ft')} AS side_yard_accuracy,
           {_relative('predicted_max_height_feet_total', 'max_height_feet_total')} AS height_accuracy,
           {_relative('predicted_maximum_far', 'maximum_far')} AS far_accuracy,
           strftime(test_date, '%Y-%m-%d %H:%M:%S') AS test_date, document_complexity
    FROM zone_results r JOIN experiments e ON r.prompt_experiment_id = e.id
         JOIN gt_requirements q ON r.ground_truth_req_id = q.id JOIN gt_documents d ON q.ground_truth_doc_id = d.id
    WHERE test_date >= DATE '2001-11-05' - INTERVAL 60 DAY""", (EXP, TZR, GTR, GTD))
def field_accuracy_heatmap(t):
    return rounded(reports.field_accuracy_heatmap(t.zone_results, t.experiments, t.gt_requirements,
                                                  t.gt_documents, AS_OF))


@query("zone_extraction_analysis", """
    WITH j AS (
      SELECT q.zone, d.town, d.county, d.state, d.document_complexity, r.*
      FROM gt_requirements q JOIN gt_documents d ON q.ground_truth_doc_id = d.id
           LEFT JOIN zone_results r ON q.id = r.ground_truth_req_id
      WHERE test_date >= DATE '2001-11-05' - INTERVAL 365 DAY OR test_date IS NULL),
    m AS (SELECT zone, town, county, state, document_complexity, predicted_zone, count(*) AS c FROM j
          WHERE predicted_zone IS NOT NULL GROUP BY ALL),
    top AS (SELECT *, row_number() OVER (PARTITION BY zone, town, county, state, document_complexity
                                         ORDER BY c DESC, predicted_zone) AS rn FROM m),
    g AS (SELECT zone, town, county, state, document_complexity, count(prompt_experiment_id) AS total_tests,
             avg(zone_accuracy_score) AS a, count(*) FILTER (WHERE predicted_zone = zone) AS good,
             count(*) FILTER (WHERE predicted_zone <> zone) AS bad,
             avg(CASE WHEN predicted_interior_min_lot_area_sqft IS NOT NULL THEN 1.0 ELSE 0.0 END) AS lot,
             avg(CASE WHEN predicted_principal_front_yard_ft IS NOT NULL THEN 1.0 ELSE 0.0 END) AS front,
             avg(CASE WHEN predicted_maximum_far IS NOT NULL THEN 1.0 ELSE 0.0 END) AS far,
             min(test_date) AS first_tested, max(test_date) AS last_tested
          FROM j GROUP BY 1, 2, 3, 4, 5)
    SELECT g.zone, g.town, g.county, g.state, g.document_complexity, total_tests, round(a, 9) AS avg_zone_accuracy,
           good AS correct_predictions, bad AS incorrect_predictions, predicted_zone AS most_common_prediction,
           round(lot, 9) AS lot_area_extraction_rate, round(front, 9) AS front_yard_extraction_rate,
           round(far, 9) AS far_extraction_rate, first_tested, last_tested,
           CASE WHEN a IS NULL THEN 'Untested' WHEN round(a, 9) >= 0.9 THEN 'Easy' WHEN round(a, 9) >= 0.7 THEN 'Medium' ELSE 'Hard' END
               AS extraction_difficulty,
           round_even(CASE WHEN total_tests > 0 THEN good * 100.0 / total_tests END, 1) AS prediction_accuracy_percent
    FROM g LEFT JOIN top ON rn = 1 AND g.zone = top.zone AND g.town = top.town AND g.county = top.county
         AND g.state = top.state AND g.document_complexity = top.document_complexity""", (TZR, GTR, GTD))
def zone_extraction_analysis(t):
    return rounded(reports.zone_extraction_analysis(t.zone_results, t.gt_requirements, t.gt_documents, AS_OF, 365))


@query("ground_truth_overview", """
    SELECT d.*, coalesce(n, 0) AS verified_zones FROM gt_documents d LEFT JOIN
      (SELECT ground_truth_doc_id, count(*) AS n FROM gt_requirements GROUP BY 1) q ON d.id = ground_truth_doc_id""",
       (GTD, GTR))
def ground_truth_overview(t):
    return stats.ground_truth_overview(t.gt_documents, t.gt_requirements)


@query("document_stats", """
    SELECT count(*) AS total_documents, count(*) FILTER (WHERE processing_status = 'completed')
           AS processed_documents, count(*) FILTER (WHERE processing_status = 'failed') AS failed_documents,
           CAST(coalesce(sum(file_size), 0) AS BIGINT) AS total_size FROM zdocuments""", ("zdocuments",))
def document_stats(t):
    return stats.document_stats(t.zdocuments)


@query("jobs_summary", "SELECT count(*) AS total_jobs, " + ", ".join(
    f"count(*) FILTER (WHERE processing_status = '{s}') AS {s}_jobs"
    for s in ("pending", "processing", "completed", "failed")) + " FROM jobs", ("jobs",))
def jobs_summary(t):
    return stats.jobs_summary(t.jobs)


@query("zones_with_locations", """
    WITH p AS (SELECT DISTINCT zone, town, county, state FROM requirements),
    t AS (SELECT zone, count(*) AS location_count FROM p GROUP BY 1)
    SELECT p.zone, state, county, string_agg(town, '; ' ORDER BY town) AS towns, count(*) AS town_count,
           any_value(location_count) AS location_count
    FROM p JOIN t ON p.zone = t.zone GROUP BY 1, 2, 3""", ("requirements",))
def zones_with_locations(t):
    return stats.zones_with_locations(t.requirements)


@query("distinct_zones", "SELECT DISTINCT zone, town, county, state FROM requirements", ("requirements",))
def distinct_zones(t):
    return stats.distinct_zones(t.requirements)


@query("duplicate_documents", """
    SELECT original_filename, copies, id, created_at, rn = 1 AS is_kept FROM (
      SELECT *, count(*) OVER (PARTITION BY original_filename) AS copies,
             row_number() OVER (PARTITION BY original_filename ORDER BY created_at DESC, id DESC) AS rn
      FROM zdocuments WHERE original_filename IS NOT NULL) WHERE copies > 1""", ("zdocuments",))
def duplicate_documents(t):
    return stats.duplicate_documents(t.zdocuments)


@query("table_counts", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS row_count, max(created_at) AS latest FROM {b}"
    for n, b in (("documents", "zdocuments"), ("jobs", "jobs"), ("requirements", "requirements"))),
       ("zdocuments", "jobs", "requirements"))
def table_counts(t):
    return stats.table_counts({"documents": t.zdocuments, "jobs": t.jobs, "requirements": t.requirements})


EXPORT_SQL = """SELECT id, job_id, town, county, state, zone, NULL AS data_source, interior_min_lot_area_sqft,
    NULL AS interior_min_lot_frontage_ft, principal_front_yard_ft, NULL AS principal_side_yard_ft,
    NULL AS principal_rear_yard_ft, NULL AS max_building_coverage_percent, max_lot_coverage_percent,
    NULL AS max_height_stories, NULL AS max_height_feet_total, NULL AS maximum_far,
    round(extraction_confidence, 9) AS extraction_confidence, created_at FROM requirements"""


@query("requirements_export", EXPORT_SQL, ("requirements",), {
    "data_source": "VARCHAR", "max_height_stories": "INTEGER", **{c: "DOUBLE" for c in (
        "interior_min_lot_frontage_ft", "principal_side_yard_ft", "principal_rear_yard_ft",
        "max_building_coverage_percent", "max_height_feet_total", "maximum_far")}})
def requirements_export(t):
    return rounded(reports.requirements_export(t.requirements, limit=None))


@query("jobs_export", """SELECT id, town, county, state, NULL AS pdf_filename, processing_status,
    NULL AS ai_model_used, created_at, NULL AS updated_at, NULL AS processing_started_at,
    NULL AS processing_completed_at FROM jobs""", ("jobs",), {
    "pdf_filename": "VARCHAR", "ai_model_used": "VARCHAR", "updated_at": "TIMESTAMP",
    "processing_started_at": "TIMESTAMP", "processing_completed_at": "TIMESTAMP"})
def jobs_export(t):
    return reports.jobs_export(t.jobs, limit=None)


# --- listings -------------------------------------------------------------------

@query("scan_project", """SELECT prompt_experiment_id, test_date, extraction_success FROM tests""", (TESTS,))
def scan_project(t):
    return t.tests.select("prompt_experiment_id", "test_date", "extraction_success")


REQ_COLUMNS = "id, job_id, town, county, state, zone, interior_min_lot_area_sqft, principal_front_yard_ft, " \
              "max_lot_coverage_percent, round(extraction_confidence, 9) AS extraction_confidence, created_at"


@query("search_requirements", f"""SELECT {REQ_COLUMNS} FROM requirements
    WHERE town ILIKE '%town_1%' AND state = 'NJ' AND zone ILIKE '%brand#2%'
    ORDER BY town, zone, id LIMIT 50 OFFSET 10""", ("requirements",))
def search_requirements(t):
    return rounded(search.search_requirements(t.requirements, town="town_1", state="NJ", zone="brand#2",
                                              limit=50, offset=10))


@query("requirements_by_location", f"""SELECT {REQ_COLUMNS} FROM requirements
    WHERE town = 'Town_7' AND state = 'NJ' AND county = 'County_0'""", ("requirements",))
def requirements_by_location(t):
    return rounded(search.requirements_by_location(t.requirements, "Town_7", "NJ", "County_0"))


@query("search_jobs", """SELECT * FROM jobs WHERE processing_status = 'completed' AND town ILIKE '%town_2%'
    AND state = 'NJ' ORDER BY created_at DESC, id LIMIT 100 OFFSET 5""", ("jobs",))
def search_jobs(t):
    return search.search_jobs(t.jobs, status="completed", town="town_2", state="NJ", limit=100, offset=5)


@query("list_documents", """SELECT *, (SELECT count(*) FROM zdocuments WHERE processing_status = 'completed'
      AND municipality ILIKE '%src1%') AS total
    FROM zdocuments WHERE processing_status = 'completed' AND municipality ILIKE '%src1%'
    ORDER BY created_at DESC, id LIMIT 20 OFFSET 10""", ("zdocuments",))
def list_documents(t):
    return search.list_documents(t.zdocuments, status="completed", municipality="src1", skip=10, limit=20)


@query("document_by_id", "SELECT * FROM zdocuments WHERE id IN (SELECT document_id FROM status_events)",
       ("zdocuments", "status_events"))
def document_by_id(t):
    return search.by_ids(t.zdocuments, t.status_events.select(F.col("document_id").alias("id")))


@query("gt_requirements_for_doc", """SELECT g.*, document_name FROM gt_requirements g
    JOIN gt_documents d ON ground_truth_doc_id = d.id""", (GTR, GTD))
def gt_requirements_for_doc(t):
    return search.gt_requirements_for_docs(t.gt_requirements, t.gt_documents)
