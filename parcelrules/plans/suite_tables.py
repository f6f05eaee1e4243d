"""Table maintenance, constraints and clean-up as named queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelrules.operators import guarded, maintenance as m, quality, stats
from parcelrules.plans.registry import query, rounded
from parcelrules.plans.suite_reports import STATS_COLUMNS, STATS_SQL
from parcelrules.sources import footers

REQ, CHG, JOBS, DOCS = "requirements", "requirement_changes", "jobs", "zdocuments"
KEY = "town, county, state, zone"
VALUES = "job_id, interior_min_lot_area_sqft, principal_front_yard_ft, max_lot_coverage_percent, " \
         "round(extraction_confidence, 9) AS extraction_confidence"
NOW = "TIMESTAMP '2024-06-01 00:00:00'"


@query("upsert_requirements", f"""
    WITH u AS (SELECT *, 0 AS pr FROM requirements UNION ALL BY NAME SELECT *, 1 AS pr FROM requirement_changes),
    r AS (SELECT *, row_number() OVER (PARTITION BY {KEY}, CASE WHEN county IS NULL THEN id END
                                       ORDER BY pr DESC, created_at DESC, id DESC) AS rn FROM u)
    SELECT id, {KEY}, {VALUES}, created_at FROM r WHERE rn = 1""", (REQ, CHG))
def upsert_requirements(t):
    return rounded(m.upsert(t.requirements, t.requirement_changes))


@query("upsert_touching", f"""
    WITH u AS (SELECT *, 0 AS pr FROM requirements UNION ALL BY NAME SELECT *, 1 AS pr FROM requirement_changes),
    r AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY {KEY}, CASE WHEN county IS NULL THEN id END) AS n
          FROM u WINDOW w AS (PARTITION BY {KEY}, CASE WHEN county IS NULL THEN id END ORDER BY pr DESC, created_at DESC, id DESC))
    SELECT id, {KEY}, {VALUES}, created_at, CASE WHEN pr = 1 AND n > 1 THEN {NOW} ELSE created_at END AS updated_at
    FROM r WHERE rn = 1""", (REQ, CHG))
def upsert_touching(t):
    stamped = [rows.withColumn("updated_at", F.col("created_at")) for rows in (t.requirements, t.requirement_changes)]
    return rounded(m.upsert_touching(*stamped, F.expr(NOW)))


@query("upsert_keep_created", f"""
    WITH u AS (SELECT *, 0 AS pr FROM requirements UNION ALL BY NAME SELECT *, 1 AS pr FROM requirement_changes),
    r AS (SELECT *, row_number() OVER w AS rn,
                 first_value(id) OVER (PARTITION BY {KEY}, CASE WHEN county IS NULL THEN id END
                                       ORDER BY pr, created_at, id) AS first_id,
                 first_value(created_at) OVER (PARTITION BY {KEY}, CASE WHEN county IS NULL THEN id END
                                               ORDER BY pr, created_at, id) AS first_at
          FROM u WINDOW w AS (PARTITION BY {KEY}, CASE WHEN county IS NULL THEN id END
                              ORDER BY pr DESC, created_at DESC, id DESC))
    SELECT first_id AS id, {KEY}, {VALUES}, first_at AS created_at FROM r WHERE rn = 1""", (REQ, CHG))
def upsert_keep_created(t):
    return rounded(m.upsert_keep_created(t.requirements, t.requirement_changes))


@query("insert_ignore", """
    SELECT * FROM experiments UNION ALL BY NAME
    SELECT * EXCLUDE (rn) FROM (
      SELECT *, row_number() OVER (PARTITION BY prompt_name, prompt_version ORDER BY id) AS rn FROM seed_experiments s
      WHERE NOT EXISTS (SELECT 1 FROM experiments e WHERE e.prompt_name = s.prompt_name
                        AND e.prompt_version = s.prompt_version)) WHERE rn = 1""", ("experiments", "seed_experiments"))
def insert_ignore(t):
    return m.insert_ignore(t.experiments, t.seed_experiments, ["prompt_name", "prompt_version"])


@query("create_jobs", """
    WITH d AS (SELECT id AS document_id, original_filename, created_at,
        CASE WHEN coalesce(municipality, '') IN ('', 'Unknown')
             THEN 'Unknown_' || replace(left(original_filename, 30), '.', '_') ELSE municipality END AS town,
        '' AS county, state FROM zdocuments)
    SELECT *, row_number() OVER (PARTITION BY town, county, state ORDER BY created_at, document_id) = 1 AS accepted
    FROM d""", (DOCS,))
def create_jobs(t):
    return m.create_jobs(t.zdocuments)


@query("apply_status_events", """
    WITH f AS (
      SELECT document_id,
        arg_max(status, row(event_at, event_id)) FILTER (WHERE action = 'update') AS last_status,
        arg_max(response_text, row(event_at, event_id)) FILTER (WHERE response_text IS NOT NULL) AS response_text,
        arg_max(error_message, row(event_at, event_id)) FILTER (WHERE error_message IS NOT NULL) AS error_message,
        max(event_at) FILTER (WHERE status IN ('completed', 'failed')) AS closed_at,
        max(event_at) FILTER (WHERE action = 'update') AS last_update,
        min(row(event_at, event_id)) FILTER (WHERE action = 'update') AS first_update,
        min(row(event_at, event_id)) FILTER (WHERE action = 'start') AS first_start,
        arg_min(event_at, row(event_at, event_id)) FILTER (WHERE action = 'start') AS start_at
      FROM status_events GROUP BY 1),
    d AS (SELECT z.*, f.*, processing_status = 'uploaded' AND first_start IS NOT NULL
                 AND (first_update IS NULL OR first_start < first_update) AS started
          FROM zdocuments z LEFT JOIN f ON z.id = f.document_id)
    SELECT id, original_filename, file_size, municipality, state, created_at,
           coalesce(last_status, CASE WHEN started THEN 'processing' END, processing_status) AS processing_status,
           CASE WHEN started THEN start_at END AS processing_started_at, closed_at AS processing_completed_at,
           response_text, error_message, greatest(last_update, CASE WHEN started THEN start_at END) AS updated_at
    FROM d""", (DOCS, "status_events"))
def apply_status_events(t):
    return m.apply_document_events(t.zdocuments, t.status_events)


@query("apply_job_events", """
    WITH f AS (
      SELECT job_id, arg_max(status, row(event_at, event_id)) AS last_status,
        arg_max(ai_model_used, row(event_at, event_id)) FILTER (WHERE ai_model_used IS NOT NULL) AS ai_model_used,
        min(event_at) FILTER (WHERE status = 'processing') AS processing_started_at,
        max(event_at) FILTER (WHERE status IN ('completed', 'failed')) AS processing_completed_at,
        max(event_at) AS updated_at
      FROM job_events GROUP BY 1)
    SELECT id, town, county, state, created_at, coalesce(last_status, processing_status) AS processing_status,
           f.ai_model_used, f.processing_started_at, f.processing_completed_at, f.updated_at
    FROM jobs LEFT JOIN f ON id = job_id""", (JOBS, "job_events"))
def apply_job_events(t):
    return m.apply_job_events(t.jobs, t.job_events)


@query("remove_orphans", """
    WITH r AS (SELECT * FROM requirements WHERE job_id IS NULL OR job_id IN (SELECT id FROM jobs)),
    j AS (SELECT * FROM jobs WHERE processing_status = 'pending' OR id IN (SELECT job_id FROM r WHERE job_id IS NOT NULL))
    SELECT 'jobs' AS table_name, id FROM j UNION ALL SELECT 'requirements', id FROM r""", (REQ, JOBS))
def remove_orphans(t):
    requirements, jobs = m.remove_orphans(t.requirements, t.jobs)
    return jobs.select(F.lit("jobs").alias("table_name"), "id").unionByName(
        requirements.select(F.lit("requirements").alias("table_name"), "id"))


@query("dedupe_documents", """
    SELECT id, original_filename, file_size, municipality, state, processing_status, created_at FROM (
      SELECT *, row_number() OVER (PARTITION BY original_filename ORDER BY created_at DESC, id DESC) AS rn
      FROM zdocuments) WHERE rn = 1 OR original_filename IS NULL""", (DOCS,))
def dedupe_documents(t):
    return m.dedupe_documents(t.zdocuments)


@query("orphan_requirements", "SELECT id, job_id, zone FROM requirements WHERE job_id NOT IN (SELECT id FROM jobs)",
       (REQ, JOBS))
def orphan_requirements(t):
    return m.orphan_requirements(t.requirements, t.jobs).select("id", "job_id", "zone")


@query("orphan_jobs", """
    SELECT id, town, processing_status FROM jobs WHERE id NOT IN (
      SELECT DISTINCT job_id FROM requirements WHERE job_id IS NOT NULL
      UNION SELECT id FROM jobs WHERE processing_status = 'pending')""", (REQ, JOBS))
def orphan_jobs(t):
    return m.orphan_jobs(t.jobs, t.requirements).select("id", "town", "processing_status")


@query("cascade_delete", """
    WITH gone AS (SELECT id FROM experiments WHERE NOT is_active)
    SELECT 'tests' AS table_name, count(*) AS remaining_rows, CAST(sum(ground_truth_doc_id) AS BIGINT) AS key_sum
    FROM tests WHERE prompt_experiment_id NOT IN (SELECT id FROM gone)
    UNION ALL
    SELECT 'zone_results', count(*), CAST(sum(ground_truth_req_id) AS BIGINT) FROM zone_results
    WHERE prompt_experiment_id NOT IN (SELECT id FROM gone)""", ("experiments", "tests", "zone_results"))
def cascade_delete(t):
    gone = t.experiments.where(~F.col("is_active"))
    tests = m.delete_children(t.tests, gone, "prompt_experiment_id")
    results = m.delete_children(t.zone_results, gone, "prompt_experiment_id")

    def counted(df, name, key):
        return df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("remaining_rows"),
                      F.sum(key).alias("key_sum"))

    return counted(tests, "tests", "ground_truth_doc_id").unionByName(
        counted(results, "zone_results", "ground_truth_req_id"))


@query("toggle_experiment", """SELECT * EXCLUDE (is_active), CASE WHEN id = 7 THEN FALSE ELSE is_active END
    AS is_active FROM experiments""", ("experiments",))
def toggle_experiment(t):
    return m.toggle_experiment(t.experiments, 7, False)




@query("toggle_touches", f"""SELECT * EXCLUDE (is_active), CASE WHEN id = 7 THEN FALSE ELSE is_active END AS is_active,
    CASE WHEN id = 7 AND is_active THEN {NOW} ELSE created_at END AS updated_at FROM experiments""", ("experiments",))
def toggle_touches(t):
    return m.toggle_experiment(t.experiments.withColumn("updated_at", F.col("created_at")), 7, False, F.expr(NOW))


@query("delete_where", "SELECT * FROM requirements WHERE NOT coalesce(zone = 'Brand#11' OR state IS NULL, FALSE)", ("requirements",))
def delete_where(t):
    return m.delete_where(t.requirements, (F.col("zone") == "Brand#11") | F.col("state").isNull())


@query("add_experiments", """
    SELECT id, prompt_name, prompt_version, llm_model, is_baseline, is_active, created_at FROM experiments
    UNION ALL SELECT id, prompt_name, '1.0', llm_model, FALSE, TRUE, created_at FROM seed_experiments""", ("experiments", "seed_experiments"))
def add_experiments(t):
    return m.add_experiments(t.experiments, t.seed_experiments.drop("prompt_version", "is_baseline", "is_active"))


@query("add_gt_documents", """SELECT * FROM gt_documents UNION ALL
    SELECT id + 10000000, document_name, town, county, 'NJ', 'medium', NULL FROM gt_documents WHERE document_complexity <> 'simple'""",
       ("gt_documents",))
def add_gt_documents(t):
    new = t.gt_documents.where("document_complexity <> 'simple'").select(
        (F.col("id") + 10000000).alias("id"), "document_name", "town", "county")
    return m.add_gt_documents(t.gt_documents, new)


# New truth rows: some of an unknown document, without a zone, below zero, of a key the table has or the batch has twice.
def new_truth(shift: int, half: int) -> list[str]:
    return [f"id + {shift} AS id", "CASE WHEN id % 5 = 0 THEN id + 900000000 ELSE ground_truth_doc_id END AS ground_truth_doc_id",
            "CASE WHEN id % 11 = 0 THEN NULL WHEN id % 3 = 0 THEN zone ELSE 'New' END AS zone",
            f"CASE WHEN id % 13 = 0 AND id % 2 = {half} THEN -1 ELSE interior_min_lot_area_sqft END AS interior_min_lot_area_sqft",
            "principal_front_yard_ft"]


TRUTH_BATCH = f"""SELECT {', '.join(new_truth(10000000, 0))} FROM gt_requirements
    UNION ALL SELECT {', '.join(new_truth(20000000, 1))} FROM gt_requirements WHERE id % 7 < 3"""
TRUTH_SQL = f"""n AS ({TRUTH_BATCH}),
    j AS (SELECT *, zone IS NULL AS no_zone, interior_min_lot_area_sqft < 0 AS below, ground_truth_doc_id NOT IN (SELECT id FROM gt_documents) AS lost,
                 EXISTS (SELECT 1 FROM gt_requirements g WHERE g.ground_truth_doc_id = n.ground_truth_doc_id AND g.zone = n.zone) AS taken FROM n),
    k AS (SELECT *, min(CASE WHEN NOT (no_zone OR below OR lost) THEN id END) OVER (PARTITION BY ground_truth_doc_id, zone) AS first_id FROM j),
    judged AS (SELECT *, concat_ws('; ', CASE WHEN no_zone THEN 'zone not null' END,
        CASE WHEN below THEN 'interior_min_lot_area_sqft not negative' END, CASE WHEN lost THEN 'ground_truth_doc_id unknown' END,
        CASE WHEN taken THEN 'key taken' WHEN NOT (no_zone OR below OR lost) AND id <> first_id THEN 'key twice' END) AS reasons FROM k)"""


def judged_truth(t):
    old = t.gt_requirements
    new = old.selectExpr(*new_truth(10000000, 0)).unionByName(old.where("id % 7 < 3").selectExpr(*new_truth(20000000, 1)))
    return guarded.truth_rows(old, new, t.gt_documents)


@query("guarded_truth_rejects", f"""WITH {TRUTH_SQL} SELECT id, ground_truth_doc_id, zone, reasons FROM judged WHERE reasons <> ''""",
       ("gt_documents", "gt_requirements"))
def guarded_truth_rejects(t):
    _, bad = guarded.append(t.gt_requirements, judged_truth(t))
    return bad.select("id", "ground_truth_doc_id", "zone", F.array_join("reasons", "; ").alias("reasons"))


@query("guarded_truth_table", f"""WITH {TRUTH_SQL} SELECT * FROM gt_requirements UNION ALL SELECT id, ground_truth_doc_id, zone,
    interior_min_lot_area_sqft, principal_front_yard_ft, NULL, NULL, NULL FROM judged WHERE reasons = ''""", ("gt_documents", "gt_requirements"))
def guarded_truth_table(t):
    return guarded.append(t.gt_requirements, judged_truth(t))[0]


@query("guarded_tests", """
    WITH n AS (SELECT * REPLACE (CASE WHEN part_id % 9 = 0 THEN prompt_experiment_id + 900000000 ELSE prompt_experiment_id END AS prompt_experiment_id,
        overall_accuracy_score * (CASE WHEN part_id % 8 = 0 THEN 1.2 ELSE 1 END) AS overall_accuracy_score) FROM tests)
    SELECT prompt_experiment_id, ground_truth_doc_id, part_id, test_epoch, concat_ws('; ',
        CASE WHEN overall_accuracy_score > 1 THEN 'overall_accuracy_score within 0..1' END,
        CASE WHEN prompt_experiment_id NOT IN (SELECT id FROM experiments) THEN 'prompt_experiment_id unknown' END,
        CASE WHEN ground_truth_doc_id NOT IN (SELECT id FROM gt_documents) THEN 'ground_truth_doc_id unknown' END) AS reasons
    FROM n""", ("experiments", "gt_documents", "tests"))
def guarded_tests(t):
    wrong = F.when(F.col("part_id") % 9 == 0, F.col("prompt_experiment_id") + 900000000).otherwise(F.col("prompt_experiment_id"))
    new = t.tests.withColumn("prompt_experiment_id", wrong).withColumn(
        "overall_accuracy_score", F.col("overall_accuracy_score") * F.when(F.col("part_id") % 8 == 0, 1.2).otherwise(1.0))
    told = guarded.judged(t.tests, new, quality.rules("tests", new.columns), {
        "prompt_experiment_id": t.experiments, "ground_truth_doc_id": t.gt_documents})
    return told.select("prompt_experiment_id", "ground_truth_doc_id", "part_id", "test_epoch", F.array_join("reasons", "; ").alias("reasons"))


@query("record_failed_tests", """SELECT ground_truth_doc_id, prompt_experiment_id, 0.0 AS overall_accuracy_score,
    0.0 AS location_extraction_accuracy, 1 AS test_epoch
    FROM tests WHERE NOT extraction_success""",
       ("tests",), {"overall_accuracy_score": "DOUBLE", "location_extraction_accuracy": "DOUBLE", "test_epoch": "INTEGER"})
def record_failed_tests(t):
    new = t.tests.where("NOT extraction_success").select("prompt_experiment_id", "ground_truth_doc_id", "test_date", "extraction_success")
    both = m.record_tests(t.tests.where("extraction_success"), new)
    return both.where("NOT extraction_success").select("ground_truth_doc_id", "prompt_experiment_id", "overall_accuracy_score",
                                                       "location_extraction_accuracy", F.col("test_epoch").cast("int").alias("test_epoch"))


@query("record_tests", f"""WITH {STATS_SQL.replace('FROM tests GROUP', 'FROM (SELECT * FROM tests UNION ALL '
       'SELECT * REPLACE (1.0 AS overall_accuracy_score) FROM tests WHERE extraction_success) GROUP')}
    SELECT {STATS_COLUMNS} FROM stats""", ("experiments", "tests"))
def record_tests(t):
    new = t.tests.where("extraction_success").withColumn("overall_accuracy_score", F.lit(1.0)).drop("test_epoch")
    return rounded(stats.experiment_stats(t.experiments, m.record_tests(t.tests, new)))


@query("retry_outcomes", """
    SELECT path, first_success, attempts_made, CASE WHEN first_success <= 3 THEN 'processed'
           WHEN attempts_made >= 3 THEN 'failed' ELSE 'retry' END AS status
    FROM (SELECT path, min(attempt_no) FILTER (WHERE ok) AS first_success, max(attempt_no) AS attempts_made
          FROM attempts GROUP BY 1)""", ("attempts",))
def retry_outcomes(t):
    return m.retry_outcomes(t.attempts)


@query("admit_files", """
    SELECT id, original_filename, file_size, CASE WHEN NOT original_filename LIKE '%.txt' THEN 'suffix'
           WHEN file_size > 52428800 THEN 'size' END AS reject_reason FROM zdocuments""", (DOCS,))
def admit_files(t):
    return m.admit_files(t.zdocuments).select("id", "original_filename", "file_size", "reject_reason")


@query("register_documents", """
    SELECT sha256(CAST(id AS VARCHAR) || '|' || original_filename) AS document_key,
           sha256(CAST(id AS VARCHAR) || '|' || original_filename) || '.txt' AS filename, original_filename, file_size,
           coalesce(municipality, 'Unknown') AS municipality, state, 'uploaded' AS processing_status
    FROM zdocuments WHERE original_filename LIKE '%.txt' AND file_size <= 52428800""", (DOCS,))
def register_documents(t):
    return m.register_documents(m.admit_files(t.zdocuments).where("reject_reason IS NULL"))


@query("quality_violations", """
    SELECT 'requirements' AS table_name, id, 'job_id not null' AS rule FROM requirements WHERE job_id IS NULL
    UNION ALL SELECT 'requirements', id, 'max_lot_coverage_percent within 0..100' FROM requirements
              WHERE NOT max_lot_coverage_percent BETWEEN 0 AND 100
    UNION ALL SELECT 'requirements', id, 'extraction_confidence within 0..1' FROM requirements
              WHERE NOT extraction_confidence BETWEEN 0 AND 1
    UNION ALL SELECT 'requirement_changes', id, 'extraction_confidence within 0..1' FROM requirement_changes
              WHERE NOT extraction_confidence BETWEEN 0 AND 1
    UNION ALL SELECT 'tests', ground_truth_doc_id, 'overall_accuracy_score within 0..1' FROM tests
              WHERE NOT overall_accuracy_score BETWEEN 0 AND 1
    UNION ALL SELECT 'gt_documents', id, 'document_complexity in set' FROM gt_documents
              WHERE document_complexity NOT IN ('simple', 'medium', 'complex')""",
       (REQ, CHG, "tests", "gt_documents"))
def quality_violations(t):
    sources = [("requirements", "requirements", t.requirements, "id"),
               ("requirements", "requirement_changes", t.requirement_changes, "id"),
               ("tests", "tests", t.tests, "ground_truth_doc_id"),
               ("gt_documents", "gt_documents", t.gt_documents, "id")]
    out = None
    for kind, name, df, key in sources:
        broken = quality.violations(df, quality.rules(kind, df.columns), [key]).select(
            F.lit(name).alias("table_name"), F.col(key).alias("id"), "rule")
        out = broken if out is None else out.unionByName(broken)
    return out


@query("unique_key_violations", " UNION ALL ".join(f"""SELECT '{table}' AS table_name, {' || '.join(f"CAST({k} AS VARCHAR) || '|'" for k in keys)} AS unique_key,
    count(*) AS row_count FROM {table} WHERE {' AND '.join(f'{k} IS NOT NULL' for k in keys)} GROUP BY {', '.join(keys)} HAVING count(*) > 1"""
    for table, keys in quality.UNIQUE.items()), (REQ, "jobs", "experiments", "gt_requirements"))
def unique_key_violations(t):
    tables = {"requirements": t.requirements, "jobs": t.jobs, "experiments": t.experiments, "gt_requirements": t.gt_requirements}
    out = None
    for name, keys in quality.UNIQUE.items():
        found = quality.key_violations(tables[name], keys).select(
            F.lit(name).alias("table_name"), F.concat(*[F.concat(F.col(k).cast("string"), F.lit("|")) for k in keys]).alias("unique_key"), "row_count")
        out = found if out is None else out.unionByName(found)
    return out


@query("experiment_violations", """
    SELECT id, 'llm_temperature within 0..2' AS rule FROM (SELECT *, id % 30 / 10.0 AS temperature FROM experiments) WHERE temperature > 2
    UNION ALL SELECT id, 'llm_model not null' FROM experiments WHERE id % 11 = 0
    UNION ALL SELECT id, 'prompt_name within 8 characters' FROM experiments WHERE length(prompt_name) > 8""", ("experiments",))
def experiment_violations(t):
    made = t.experiments.withColumn("llm_temperature", F.col("id") % 30 / 10.0).withColumn(
        "llm_model", F.when(F.col("id") % 11 != 0, F.col("llm_model")))
    checks = quality.rules("experiments", made.columns) | quality.length_rules({"prompt_name": 8})
    return quality.violations(made, checks, ["id"])


@query("plausibility_flags", """
    SELECT id, 'interior_min_lot_area_sqft within 5000..50000' AS rule FROM gt_requirements
    WHERE NOT interior_min_lot_area_sqft BETWEEN 5000 AND 50000
    UNION ALL SELECT id, 'principal_front_yard_ft within 5..50' FROM gt_requirements
              WHERE NOT principal_front_yard_ft BETWEEN 5 AND 50
    UNION ALL SELECT id, 'principal_side_yard_ft within 5..50' FROM gt_requirements
              WHERE NOT principal_side_yard_ft BETWEEN 5 AND 50
    UNION ALL SELECT id, 'max_height_feet_total within 25..100' FROM gt_requirements
              WHERE NOT max_height_feet_total BETWEEN 25 AND 100""", ("gt_requirements",))
def plausibility_flags(t):
    truth = t.gt_requirements
    return quality.violations(truth, quality.plausibility_rules(truth.columns), ["id"])


COUNTED = {"documents": ("doc_id", "text"), "orders": ("o_orderkey", "o_orderdate"), "lineitem": ("l_orderkey", "l_shipdate"),
           "part": ("p_partkey", "p_brand"), "supplier": ("s_suppkey", "s_acctbal")}


@query("footer_counts", " UNION ALL ".join(
    f"""SELECT '{n}' AS table_name, count(*) AS row_count, CAST(min({k}) AS BIGINT) AS least_id, CAST(max({k}) AS BIGINT) AS greatest_id,
    count({o}) AS filled_rows FROM {n}""" for n, (k, o) in COUNTED.items()))
def footer_counts(t):
    return footers.footer_counts(t.spark, {n: (f"{t.folder.rstrip('/')}/{n}.parquet", k, o) for n, (k, o) in COUNTED.items()})
