"""Counts, roll-ups and rankings.

Facts are always reduced by their own key before they meet a dimension, so a
prompt that owns a third of all tests costs one partial row per map task.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, functions as F

from parcelrules.functions.scores import success_rate
from parcelrules.functions.text import prompt_label
from parcelrules.operators.skew import splittable

TEST_MEASURES = {
    "average_accuracy_score": "overall_accuracy_score",
    "average_field_accuracy": "field_extraction_accuracy",
    "average_zone_accuracy": "zone_identification_accuracy",
}


def document_stats(documents: DataFrame) -> DataFrame:
    status = F.col("processing_status")
    return documents.agg(
        F.count(F.lit(1)).alias("total_documents"),
        F.count_if(status == "completed").alias("processed_documents"),
        F.count_if(status == "failed").alias("failed_documents"),
        F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_size"))


def jobs_summary(jobs: DataFrame) -> DataFrame:
    status = F.col("processing_status")
    return jobs.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        *[F.count_if(status == s).alias(f"{s}_jobs") for s in ("pending", "processing", "completed", "failed")])


def test_rollup(tests: DataFrame) -> DataFrame:
    """One row per experiment: counts, means and the latest test time."""
    ok = F.col("extraction_success")
    return tests.groupBy(F.col("prompt_experiment_id").alias("id")).agg(
        F.count(F.lit(1)).alias("total_tests"),
        F.count_if(ok).alias("successful_extractions"),
        F.count_if(~ok).alias("failed_extractions"),
        *[F.avg(src).alias(out) for out, src in TEST_MEASURES.items()],
        F.max("test_date").alias("last_tested_at"))


def experiment_stats(experiments: DataFrame, tests: DataFrame) -> DataFrame:
    """Experiments with their stored statistics refreshed; 0 where untested."""
    zero_filled = {c: 0 for c in ("total_tests", "successful_extractions", "failed_extractions")}
    zero_filled |= {c: 0.0 for c in TEST_MEASURES}
    return experiments.join(test_rollup(tests), "id", "left").fillna(zero_filled)


def experiment_results(experiments: DataFrame, tests: DataFrame, experiment_id: object | None = None) -> DataFrame:
    """Number of tests and mean accuracy per experiment (or of one); 0 if untested."""
    if experiment_id is not None:
        experiments = experiments.where(F.col("id") == experiment_id)
        tests = tests.where(F.col("prompt_experiment_id") == experiment_id)
    means = tests.groupBy(F.col("prompt_experiment_id").alias("id")).agg(
        F.count(F.lit(1)).alias("total_tests"), F.avg("overall_accuracy_score").alias("average_accuracy"))
    return experiments.select(F.col("id"), "prompt_name", "prompt_version").join(means, "id", "left").fillna(
        {"total_tests": 0, "average_accuracy": 0.0})


def experiment_tests(tests: DataFrame, experiment_id: object) -> DataFrame:
    """All tests of one experiment, newest first."""
    return tests.where(F.col("prompt_experiment_id") == experiment_id).orderBy(F.desc("test_date"))


def best_prompts(stats: DataFrame, min_tests: int = 5, limit: int = 10) -> DataFrame:
    return (
        stats.where(F.col("total_tests") >= min_tests)
        .orderBy(F.desc_nulls_last("average_accuracy_score"), F.desc("total_tests"), F.asc("id"))
        .limit(limit)
        .select("prompt_name", "prompt_version", "llm_model", "total_tests",
                success_rate(F.col("successful_extractions"), F.col("total_tests")).alias("success_rate"),
                F.col("average_accuracy_score").alias("avg_accuracy"),
                F.col("average_field_accuracy").alias("avg_field_accuracy"),
                F.col("average_zone_accuracy").alias("avg_zone_accuracy"),
                F.col("last_tested_at").alias("last_tested")))


def document_test_results(tests: DataFrame, experiments: DataFrame, doc_id: object | None = None) -> DataFrame:
    """Tests with their prompt, newest first, of one document or of all."""
    rows = tests if doc_id is None else tests.where(F.col("ground_truth_doc_id") == doc_id)
    return (
        rows.join(experiments.select("id", "prompt_name", "prompt_version"), F.col("prompt_experiment_id") == F.col("id"))
        .select("ground_truth_doc_id", "prompt_name", "prompt_version", "test_epoch",
                F.col("overall_accuracy_score").alias("overall_accuracy"),
                F.col("zone_identification_accuracy").alias("zone_accuracy"),
                F.col("field_extraction_accuracy").alias("field_accuracy"),
                F.col("parsed_zones_count").alias("zones_found"), "test_date"))


def test_summary(experiments: DataFrame, tests: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Experiments and tests of a period, the best prompt and the gain over the newest baseline.

    One pass: tests shrink to a row per experiment that holds both the period's
    and the all-time figures, and everything else is a global aggregate of those.
    An experiment tested only outside the period drops out; an untested one stays.
    """
    inside = F.col("test_date").between(F.lit(start), F.lit(end)) | F.col("test_date").isNull()
    acc = F.col("overall_accuracy_score")
    return summary_of(experiments, tests.groupBy(F.col("prompt_experiment_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(acc).alias("mean"),
        F.count_if(inside).alias("n_in"), F.count(F.when(inside, acc)).alias("k_in"),
        F.sum(F.when(inside, acc)).alias("sum_in")))


def summary_of(experiments: DataFrame, per_exp: DataFrame) -> DataFrame:
    """The summary from one row per experiment: all-time tests ``n`` and ``mean``, the period's ``n_in``, ``k_in`` and ``sum_in``."""
    rows = experiments.join(per_exp, "id", "left")
    n, mean = F.coalesce("n", F.lit(0)), F.coalesce("mean", F.lit(0.0))
    kept = F.col("n").isNull() | (F.col("n_in") > 0)
    best = F.max_by(prompt_label(F.col("prompt_name"), F.col("prompt_version")),
                    F.when(n >= 3, F.struct(mean, -F.col("id"))))
    return rows.agg(
        F.count_if(kept).alias("total_experiments"),
        F.coalesce(F.sum(F.when(kept, F.col("n_in"))), F.lit(0)).alias("total_tests"),
        F.try_divide(F.sum("sum_in"), F.sum("k_in")).alias("avg_accuracy"),
        best.alias("best_prompt"),
        F.max(F.when(kept, mean)).alias("best_mean"),
        F.max_by(mean, F.when(F.col("is_baseline"), F.struct("created_at", "id"))).alias("base_mean"),
    ).select(
        "total_experiments", "total_tests", "avg_accuracy", "best_prompt",
        F.when(F.col("base_mean") > 0, (F.col("best_mean") - F.col("base_mean")) / F.col("base_mean") * 100)
        .otherwise(F.lit(0.0)).alias("improvement_over_baseline"))


def ground_truth_overview(gt_documents: DataFrame, gt_requirements: DataFrame) -> DataFrame:
    """Verified documents with their number of verified zones, newest first."""
    zones = gt_requirements.groupBy(F.col("ground_truth_doc_id").alias("id")).agg(
        F.count("id").alias("verified_zones"))
    return gt_documents.join(zones, "id", "left").fillna({"verified_zones": 0})


def distinct_zones(requirements: DataFrame, town: str | None = None, state: str | None = None) -> DataFrame:
    df = requirements
    if town:
        df = df.where(F.col("town") == town)
    if state:
        df = df.where(F.col("state") == state)
    return df.select("zone", "town", "county", "state").distinct()


def zones_with_locations(requirements: DataFrame, town: str | None = None, state: str | None = None) -> DataFrame:
    """Every zone with the places that have it, one row per zone and county.

    Places are made distinct first, so a row lists at most the towns of one
    county however many requirements a zone has; the zone's total stands on
    every one of its rows.
    """
    places = distinct_zones(requirements, town, state)
    by_county = places.groupBy("zone", "state", "county").agg(
        F.array_join(F.sort_array(F.collect_list("town")), "; ").alias("towns"),
        F.count(F.lit(1)).alias("town_count"))
    totals = by_county.groupBy("zone").agg(F.sum("town_count").alias("location_count"))
    return by_county.join(totals, "zone")


def duplicate_documents(documents: DataFrame) -> DataFrame:
    """Documents that share a file name with another one, newest marked as the one to keep.

    A row per document instead of an array per name: one name may hold a third
    of all documents.
    """
    named = documents.where(F.col("original_filename").isNotNull()).select("id", "original_filename", "created_at")
    groups = (named.groupBy("original_filename")
              .agg(F.count(F.lit(1)).alias("copies"), F.max(F.struct("created_at", "id")).alias("newest"))
              .where(F.col("copies") > 1))
    return named.join(splittable(groups, "original_filename"), "original_filename").select(
        "original_filename", "copies", "id", "created_at", (F.col("newest.id") == F.col("id")).alias("is_kept"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Labelled row counts with the latest creation time, sorted by label."""
    parts = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"),
                    F.max("created_at").alias("latest")) for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy("table_name")


def last_days(column: str | Column, as_of: date | str, days: int) -> Column:
    """The last ``days`` days up to ``as_of``; a plain range the scan can prune by."""
    col = F.col(column) if isinstance(column, str) else column
    since = F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp_ntz")
    return col >= since
