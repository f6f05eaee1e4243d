"""The reports: each is one lazy plan ending in the order the report is read in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from parcelrules import fixed_values as fv
from parcelrules.functions import scores
from parcelrules.functions.text import prompt_label
from parcelrules.operators.stats import last_days
from parcelrules.schemas import JOBS, REQUIREMENTS

STAMP = "yyyy-MM-dd HH:mm:ss"
DAY = "yyyy-MM-dd"


def prompt_performance(stats: DataFrame) -> DataFrame:
    """Experiments, best mean accuracy first."""
    return stats.withColumn(
        "success_rate", scores.success_rate(F.col("successful_extractions"), F.col("total_tests"))
    )


def baseline_accuracy(tests: DataFrame, experiments: DataFrame) -> DataFrame:
    """One row: mean accuracy over all tests of all baseline prompts."""
    per_exp = tests.groupBy(F.col("prompt_experiment_id").alias("id")).agg(
        F.sum("overall_accuracy_score").alias("s"), F.count("overall_accuracy_score").alias("n"))
    return (experiments.where("is_baseline").select("id").join(per_exp, "id")
            .agg(F.try_divide(F.sum("s"), F.sum("n")).alias("baseline_accuracy")))


def with_baseline_delta(rows: DataFrame, tests: DataFrame, experiments: DataFrame) -> DataFrame:
    base = baseline_accuracy(tests, experiments).scalar()
    return rows.withColumn(
        "improvement_over_baseline", F.col("overall_accuracy_score") - F.coalesce(base, F.lit(0.0)))


def test_results_export(tests: DataFrame, experiments: DataFrame, gt_documents: DataFrame,
                        as_of: str, days: int = 30) -> DataFrame:
    """Tests of the last days with both parents, bands and the delta to the baseline.

    Parents are optional in the data, so they are left joins with defaults; the
    date filter reaches the scan of the facts before either join.
    """
    exp = experiments.select(F.col("id").alias("prompt_experiment_id"), "prompt_name", "prompt_version",
                             "llm_model", "is_baseline")
    docs = gt_documents.select(F.col("id").alias("ground_truth_doc_id"), "document_name", "town", "county",
                               "state", "document_complexity")
    recent = tests.where(last_days("test_date", as_of, days)).where(
        F.col("test_date") <= F.lit(as_of).cast("timestamp_ntz"))
    rows = recent.join(exp, "prompt_experiment_id", "left").join(docs, "ground_truth_doc_id", "left")
    rows = with_baseline_delta(rows, tests, experiments)
    texts = ("prompt_name", "prompt_version", "llm_model", "document_name", "town", "county", "state",
             "document_complexity")
    numbers = ("overall_accuracy_score", "zone_identification_accuracy", "field_extraction_accuracy",
               "location_extraction_accuracy", "parsed_zones_count", "processing_time_seconds", "llm_tokens_used")
    rows = rows.fillna("", list(texts)).fillna(0, list(numbers)).fillna(False, ["extraction_success", "is_baseline"])
    return rows.select(
        "test_epoch", F.date_format("test_date", STAMP).alias("test_date"), *numbers[:4], "parsed_zones_count",
        "extraction_success", *numbers[5:], *texts[:3], "is_baseline", *texts[3:], "improvement_over_baseline",
        scores.band(F.col("overall_accuracy_score"), fv.ACCURACY_BANDS).alias("accuracy_category"),
        scores.band(F.col("zone_identification_accuracy"), fv.ZONE_BANDS).alias("zone_extraction_category"))


DAILY_SUMS = ("overall_accuracy_score", "zone_identification_accuracy", "field_extraction_accuracy",
              "processing_time_seconds", "llm_tokens_used")


def daily_partials(tests: DataFrame, sums: tuple[str, ...] = DAILY_SUMS) -> DataFrame:
    """Sums and counts per day and experiment, from which any daily or total mean follows."""
    return tests.groupBy(F.to_date("test_date").alias("day"), F.col("prompt_experiment_id").alias("id")).agg(
        F.count(F.lit(1)).alias("tests"), F.count_if("extraction_success").alias("ok"),
        *[F.sum(c).alias(f"s_{c}") for c in sums], *[F.count(c).alias(f"n_{c}") for c in sums])


def _daily(tests: DataFrame, experiments: DataFrame, dims: list[str], sums: dict[str, str],
           as_of: str, days: int, partials: DataFrame | None = None) -> DataFrame:
    """Daily sums and counts per prompt, reduced by experiment before the join; from stored ``partials`` where given."""
    if partials is None:
        partial = daily_partials(tests.where(last_days("test_date", as_of, days)), tuple(sums.values()))
    else:
        partial = partials.where(F.col("day") >= F.date_sub(F.lit(as_of).cast("date"), days))
    joined = partial.join(experiments.select("id", *dims), "id")
    return joined.groupBy("day", *dims).agg(
        F.sum("tests").alias("tests"), F.sum("ok").alias("ok"),
        *[F.try_divide(F.sum(f"s_{c}"), F.sum(f"n_{c}")).alias(n) for n, c in sums.items()])


def accuracy_trends(tests: DataFrame | None, experiments: DataFrame, as_of: str, days: int = 90,
                    partials: DataFrame | None = None) -> DataFrame:
    """Daily means per prompt and model with a trend and a 1-5 rating.

    ``accuracy_trend`` compares with the row before it in report order (newest
    first), ``accuracy_change`` with the day before.
    """
    means = {"daily_avg_accuracy": "overall_accuracy_score",
             "daily_avg_zone_accuracy": "zone_identification_accuracy",
             "daily_avg_field_accuracy": "field_extraction_accuracy",
             "avg_processing_time": "processing_time_seconds", "avg_tokens_used": "llm_tokens_used"}
    daily = _daily(tests, experiments, ["prompt_name", "prompt_version", "llm_model"], means, as_of, days, partials)
    prompt = Window.partitionBy("prompt_name", "prompt_version")
    acc = F.col("daily_avg_accuracy")
    newest_first = prompt.orderBy(F.desc("day"), F.desc_nulls_first("daily_avg_accuracy"), "llm_model")
    oldest_first = prompt.orderBy("day", F.asc_nulls_last("daily_avg_accuracy"), F.desc("llm_model"))
    return daily.select(
        F.date_format("day", DAY).alias("test_date"), "prompt_name", "prompt_version", "llm_model",
        *means, F.col("tests").alias("tests_per_day"), F.col("ok").alias("successful_tests"),
        (acc - F.lag(acc).over(newest_first)).alias("accuracy_trend"),
        (acc - F.lag(acc).over(oldest_first)).alias("accuracy_change"),
        scores.band(acc, fv.RATING_BANDS).alias("performance_rating"),
    ).orderBy(F.desc("test_date"), F.desc_nulls_first("daily_avg_accuracy"))


def accuracy_timeline(tests: DataFrame | None, experiments: DataFrame, as_of: str, days: int = 90,
                      partials: DataFrame | None = None) -> DataFrame:
    """Daily accuracy per prompt against the day's baseline and the prompt's day before."""
    means = {"daily_accuracy": "overall_accuracy_score", "daily_zone_accuracy": "zone_identification_accuracy",
             "daily_field_accuracy": "field_extraction_accuracy"}
    daily = _daily(tests, experiments, ["prompt_name", "prompt_version", "is_baseline"], means, as_of, days, partials)
    acc = F.col("daily_accuracy")
    # A window over the day's prompt means: joining a second aggregate would scan the facts twice.
    baseline = F.avg(F.when(F.col("is_baseline"), acc)).over(Window.partitionBy("day"))
    before = F.lag(acc).over(Window.partitionBy("prompt_name", "prompt_version").orderBy("day"))
    return (
        daily.withColumn("baseline_accuracy", baseline)
        .withColumn("previous_day_accuracy", before)
        .withColumn("day_over_day_change", acc - F.col("previous_day_accuracy"))
        .select(
            F.date_format("day", DAY).alias("test_date"), "prompt_name", "prompt_version", "is_baseline", *means,
            F.col("tests").alias("daily_tests"), "baseline_accuracy",
            (acc - F.coalesce("baseline_accuracy", F.lit(0.0))).alias("improvement_over_baseline"),
            "previous_day_accuracy", "day_over_day_change",
            prompt_label(F.col("prompt_name"), F.col("prompt_version")).alias("prompt_full_name"),
            scores.trend_direction(F.col("day_over_day_change")).alias("trend_direction"))
        .orderBy(F.desc("test_date"), F.desc_nulls_first("daily_accuracy")))


HEATMAP_FIELDS = {
    "lot_area_accuracy": "interior_min_lot_area_sqft",
    "front_yard_accuracy": "principal_front_yard_ft",
    "side_yard_accuracy": "principal_side_yard_ft",
    "height_accuracy": "max_height_feet_total",
    "far_accuracy": "maximum_far",
}


def with_test_columns(zone_results: DataFrame, tests: DataFrame | None) -> DataFrame:
    """Zone results with the experiment and date of their test, if not already there."""
    if tests is None:
        return zone_results
    return zone_results.join(
        tests.select(F.col("id").alias("requirements_test_id"), "prompt_experiment_id", "test_date"),
        "requirements_test_id", "left")


def field_accuracy_heatmap(zone_results: DataFrame, experiments: DataFrame, gt_requirements: DataFrame,
                           gt_documents: DataFrame, as_of: str, days: int = 60,
                           tests: DataFrame | None = None) -> DataFrame:
    """Relative accuracy of five fields per zone result of the last days."""
    recent = with_test_columns(zone_results, tests).where(last_days("test_date", as_of, days))
    exp = experiments.select(F.col("id").alias("prompt_experiment_id"), "prompt_name", "prompt_version")
    truth = gt_requirements.select(F.col("id").alias("ground_truth_req_id"), "ground_truth_doc_id",
                                   *HEATMAP_FIELDS.values())
    docs = gt_documents.select(F.col("id").alias("ground_truth_doc_id"), "document_complexity")
    # The two truth tables meet first: both are far smaller than the facts.
    verified = truth.join(docs, "ground_truth_doc_id")
    rows = recent.join(exp, "prompt_experiment_id").join(verified, "ground_truth_req_id")
    return rows.select(
        "prompt_name", "prompt_version", "predicted_zone", "actual_zone",
        *[scores.relative_accuracy(F.col(f"predicted_{f}"), F.col(f)).alias(n) for n, f in HEATMAP_FIELDS.items()],
        F.date_format("test_date", STAMP).alias("test_date"), "document_complexity")


def zone_extraction_analysis(zone_results: DataFrame, gt_requirements: DataFrame, gt_documents: DataFrame,
                             as_of: str, days: int = 90, tests: DataFrame | None = None) -> DataFrame:
    """How hard each verified zone is to extract, hardest first.

    Results are reduced to (verified zone, predicted zone) before any join, which
    also gives the most common prediction without a per-group value map. A zone
    tested only outside the period drops out; an untested zone stays.
    """
    rated = F.col("zone_accuracy_score")
    inside = last_days("test_date", as_of, days) | F.col("test_date").isNull()

    def rate(column: str):
        return F.count(column)

    # The figures come from the period alone; of older results only the zones' ids are read.
    partial = with_test_columns(zone_results, tests).where(inside).groupBy("ground_truth_req_id", "predicted_zone").agg(
        F.count(F.lit(1)).alias("n"), F.sum(rated).alias("score_sum"), F.count(rated).alias("score_n"),
        rate("predicted_interior_min_lot_area_sqft").alias("lot_n"),
        rate("predicted_principal_front_yard_ft").alias("front_n"),
        rate("predicted_maximum_far").alias("far_n"),
        F.min("test_date").alias("first_tested"), F.max("test_date").alias("last_tested"))
    tested = zone_results.select("ground_truth_req_id").distinct()
    keys = ["zone", "town", "county", "state", "document_complexity"]
    docs = gt_documents.select(F.col("id").alias("ground_truth_doc_id"), "town", "county", "state",
                               "document_complexity")
    truth = gt_requirements.select(F.col("id").alias("ground_truth_req_id"), "ground_truth_doc_id", "zone")
    zones = truth.join(docs, "ground_truth_doc_id")
    # An untested zone is one row with all rates 0.
    untested = zones.join(tested, "ground_truth_req_id", "left_anti")
    rows = zones.join(partial, "ground_truth_req_id").unionByName(untested, allowMissingColumns=True).withColumn(
        "lines", F.coalesce("n", F.lit(1)))
    counts = ("n", "score_n", "lot_n", "front_n", "far_n", "lines")
    per_prediction = rows.groupBy(*keys, "predicted_zone").agg(
        *[F.sum(c).alias(c) for c in counts], F.sum("score_sum").alias("score_sum"),
        F.min("first_tested").alias("first_tested"), F.max("last_tested").alias("last_tested"))
    hit = F.col("predicted_zone") == F.col("zone")
    most_common = F.min_by("predicted_zone", F.when(F.col("predicted_zone").isNotNull(),
                                                    F.struct(-F.col("n"), F.col("predicted_zone"))))
    total = F.coalesce(F.sum("n"), F.lit(0))
    grouped = per_prediction.groupBy(*keys).agg(
        total.alias("total_tests"),
        F.try_divide(F.sum("score_sum"), F.sum("score_n")).alias("avg_zone_accuracy"),
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("correct_predictions"),
        F.coalesce(F.sum(F.when(~hit, F.col("n"))), F.lit(0)).alias("incorrect_predictions"),
        most_common.alias("most_common_prediction"),
        *[(F.coalesce(F.sum(c), F.lit(0)) / F.sum("lines")).alias(n) for n, c in (
            ("lot_area_extraction_rate", "lot_n"), ("front_yard_extraction_rate", "front_n"),
            ("far_extraction_rate", "far_n"))],
        F.min("first_tested").alias("first_tested"), F.max("last_tested").alias("last_tested"))
    return grouped.select(
        "*", scores.difficulty(F.col("avg_zone_accuracy")).alias("extraction_difficulty"),
        F.bround(F.try_divide(F.col("correct_predictions") * 100.0, F.col("total_tests")), 1)
        .alias("prediction_accuracy_percent"),
    ).orderBy(F.asc_nulls_last("avg_zone_accuracy"), F.desc("total_tests"), *keys)


REQUIREMENT_EXPORT = [
    "id", "job_id", "town", "county", "state", "zone", "data_source", "interior_min_lot_area_sqft",
    "interior_min_lot_frontage_ft", "principal_front_yard_ft", "principal_side_yard_ft", "principal_rear_yard_ft",
    "max_building_coverage_percent", "max_lot_coverage_percent", "max_height_stories", "max_height_feet_total",
    "maximum_far", "extraction_confidence", "created_at"]
JOB_EXPORT = ["id", "town", "county", "state", "pdf_filename", "processing_status", "ai_model_used", "created_at",
              "updated_at", "processing_started_at", "processing_completed_at"]


def _export(table: DataFrame, columns: list[str], schema: T.StructType, limit: int | None) -> DataFrame:
    have = set(table.columns)
    rows = table.select(*[F.col(c) if c in have else F.lit(None).cast(schema[c].dataType).alias(c) for c in columns])
    # A whole export has no order: a global sort would run the scan twice and shuffle all wide rows.
    return rows.orderBy("id").limit(limit) if limit else rows


def requirements_export(requirements: DataFrame, limit: int | None = None) -> DataFrame:
    return _export(requirements, REQUIREMENT_EXPORT, REQUIREMENTS, limit)


def jobs_export(jobs: DataFrame, limit: int | None = None) -> DataFrame:
    return _export(jobs, JOB_EXPORT, JOBS, limit)


def dashboard_results(stats: DataFrame) -> DataFrame:
    """What the dashboard lists: label, bands and percent texts per experiment."""
    rate = scores.success_rate(F.col("successful_extractions"), F.col("total_tests"))
    return stats.select(
        prompt_label(F.col("prompt_name"), F.col("prompt_version")).alias("prompt"), "llm_model", "total_tests",
        scores.percent_text(F.col("average_accuracy_score")).alias("accuracy_text"),
        scores.band(F.col("average_accuracy_score"), fv.DASHBOARD_BANDS).alias("accuracy_band"),
        scores.band(F.col("average_field_accuracy"), fv.DASHBOARD_BANDS).alias("field_band"),
        scores.band(F.col("average_zone_accuracy"), fv.DASHBOARD_BANDS).alias("zone_band"),
        F.when(F.col("total_tests") > 0, scores.percent_text(rate)).otherwise(F.lit("N/A")).alias("success_text"))
