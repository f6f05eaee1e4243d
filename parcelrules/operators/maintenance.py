"""Table maintenance: old snapshot + changes -> new snapshot.

Plain Parquet tables cannot be updated in place, so each operation is a pure
function of DataFrames. Winners are picked by aggregates (``max_by``/``min_by``),
which Spark combines on the map side, not by sorting a key's rows in one task:
a key that owns a third of all rows is no slower than the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelrules import fixed_values as fv
from parcelrules.functions.text import job_town_from_filename

UPSERT_KEY = ["town", "county", "state", "zone"]


def _conflict_key(keys: list[str], order: list[str]) -> list[Column]:
    """Grouping columns of a unique key; a key with a null part conflicts with nothing."""
    any_null = F.coalesce(*[F.when(F.col(k).isNull(), F.lit(True)) for k in keys], F.lit(False))
    alone = F.when(any_null, F.struct(*order))
    return [*[F.col(k) for k in keys], alone.alias("_alone")]


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last write wins: every column from the row with the greatest ``order`` per key."""
    rest = [c for c in rows.columns if c not in keys]
    won = rows.groupBy(*_conflict_key(keys, order)).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return won.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*rows.columns)


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First write wins."""
    rest = [c for c in rows.columns if c not in keys]
    won = rows.groupBy(*_conflict_key(keys, order)).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return won.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*rows.columns)


def upsert(old: DataFrame, changes: DataFrame, keys: list[str] = UPSERT_KEY,
           order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """Changes replace old rows of the same key in every column."""
    both = old.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return latest_per_key(both, keys, ["_new", *order]).drop("_new")


def upsert_touching(old: DataFrame, changes: DataFrame, now: Column, keys: list[str] = UPSERT_KEY,
                    order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """As :func:`upsert`; a row that replaced another, of the table or of the batch, has ``updated_at`` = ``now``."""
    ordering = ["_new", *order]
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    won = both.groupBy(*_conflict_key(keys, ordering)).agg(
        F.max_by(F.struct(*rest), F.struct(*ordering)).alias("_row"), ((F.max("_new") == 1) & (F.count(F.lit(1)) > 1)).alias("_hit"))
    return touched(won.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest], "_hit"), F.col("_hit"), now).select(*old.columns)


def upsert_keep_created(old: DataFrame, changes: DataFrame, keys: list[str] = UPSERT_KEY,
                        order: tuple[str, ...] = ("created_at", "id"),
                        kept: tuple[str, ...] = ("id", "created_at")) -> DataFrame:
    """As :func:`upsert`, but the row that first took the key keeps ``kept``."""
    ordering = F.struct("_new", *order)
    rest = [c for c in old.columns if c not in keys and c not in kept]
    both = old.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    won = both.groupBy(*_conflict_key(keys, ["_new", *order])).agg(
        F.max_by(F.struct(*rest), ordering).alias("_last"), F.min_by(F.struct(*kept), ordering).alias("_first"))
    return won.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest],
                      *[F.col(f"_first.{c}").alias(c) for c in kept]).select(*old.columns)


def insert_ignore(old: DataFrame, rows: DataFrame, keys: list[str],
                  order: tuple[str, ...] = ("id",)) -> DataFrame:
    """Add rows whose key is new; of several new rows with one key the first is taken."""
    # One row per key is picked before the join, so that a hot new key is small by then.
    fresh = first_per_key(rows, keys, list(order)).join(old.select(*keys), keys, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def create_jobs(documents: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One job per jurisdiction; later documents of the same place are rejected.

    Returns every document with its job's place and ``accepted``. Documents of an
    unknown place get a town made from their file name. ``existing`` jobs hold
    their places already.
    """
    town = F.when(F.coalesce(F.col("municipality"), F.lit("")).isin("", "Unknown"),
                  F.coalesce(job_town_from_filename(F.col("original_filename")),
                             F.concat(F.lit("Unknown_"), F.unix_timestamp("created_at").cast("string")))
                  ).otherwise(F.col("municipality"))
    county = F.coalesce(F.col("county"), F.lit("")) if "county" in documents.columns else F.lit("")
    jobs = documents.select(F.col("id").alias("document_id"), "original_filename", "created_at",
                            town.alias("town"), county.alias("county"),
                            F.coalesce(F.col("state"), F.lit(fv.DEFAULT_STATE)).alias("state"))
    place = ["town", "county", "state"]
    contenders = jobs if existing is None else jobs.join(existing.select(*place), place, "left_anti")
    winners = (contenders.groupBy(*place).agg(F.min_by("document_id", F.struct("created_at", "document_id"))
                                              .alias("document_id"))
               .select("document_id", F.lit(True).alias("accepted")))
    return jobs.join(winners, "document_id", "left").fillna({"accepted": False})


def fold_document_events(events: DataFrame) -> DataFrame:
    """A document's status events as one row of facts that decide its final state.

    Events are 'start' (only from 'uploaded') and 'update' (to processing,
    completed or failed; no event leads back to 'uploaded').
    """
    at = F.struct("event_at", "event_id")
    update, start = F.col("action") == "update", F.col("action") == "start"
    closing = update & F.col("status").isin(fv.FINAL_STATUSES)

    def newest(column: str) -> Column:
        return F.max_by(column, F.when(update & F.col(column).isNotNull(), at))

    return events.groupBy(F.col("document_id").alias("id")).agg(
        newest("status").alias("last_status"), newest("response_text").alias("last_response"),
        newest("error_message").alias("last_error"), F.max(F.when(closing, F.col("event_at"))).alias("closed_at"),
        F.max(F.when(update, F.col("event_at"))).alias("updated_at"),
        F.min(F.when(update, at)).alias("first_update"), F.min(F.when(start, at)).alias("first_start"))


def apply_document_events(documents: DataFrame, events: DataFrame) -> DataFrame:
    """Documents after all their events, in time order.

    A text that comes as null keeps the old one; 'completed' and 'failed' set the
    completion time; a start counts only while the document is still 'uploaded'.
    """
    folded = fold_document_events(events)
    started = (F.col("processing_status") == "uploaded") & F.col("first_start").isNotNull() & (
        F.col("first_update").isNull() | (F.col("first_start") < F.col("first_update")))
    have = set(documents.columns)

    def old(name: str, kind: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    fresh = {"processing_status", "processing_started_at", "processing_completed_at", "response_text",
             "error_message", "updated_at"}
    return documents.join(folded.withColumnRenamed("updated_at", "last_update_at"), "id", "left").select(
        *[c for c in documents.columns if c not in fresh],
        F.coalesce("last_status", F.when(started, F.lit("processing")), "processing_status")
        .alias("processing_status"),
        F.when(started, F.col("first_start.event_at")).otherwise(old("processing_started_at", "timestamp_ntz"))
        .alias("processing_started_at"),
        F.coalesce("closed_at", old("processing_completed_at", "timestamp_ntz")).alias("processing_completed_at"),
        F.coalesce("last_response", old("response_text", "string")).alias("response_text"),
        F.coalesce("last_error", old("error_message", "string")).alias("error_message"),
        F.coalesce(F.greatest("last_update_at", F.when(started, F.col("first_start.event_at"))),
                   old("updated_at", "timestamp_ntz")).alias("updated_at"))


def apply_job_events(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Jobs after their status updates: columns job_id, event_at, event_id, status, ai_model_used."""
    at = F.struct("event_at", "event_id")
    folded = events.groupBy(F.col("job_id").alias("id")).agg(
        F.max_by("status", at).alias("last_status"),
        F.max_by("ai_model_used", F.when(F.col("ai_model_used").isNotNull(), at)).alias("last_model"),
        F.min(F.when(F.col("status") == "processing", F.col("event_at"))).alias("first_processing_at"),
        F.max(F.when(F.col("status").isin(fv.FINAL_STATUSES), F.col("event_at"))).alias("closed_at"),
        F.max("event_at").alias("last_at"))
    have = set(jobs.columns)
    joined = jobs.join(folded, "id", "left")

    def newer(column: str, fresh: str, keep_old: bool = False) -> Column:
        both = [F.col(c) for c in ((column, fresh) if keep_old else (fresh, column)) if c == fresh or c in have]
        return F.coalesce(*both).alias(column)

    changed = ["processing_status", "ai_model_used", "processing_started_at", "processing_completed_at", "updated_at"]
    return joined.select(
        *[c for c in jobs.columns if c not in changed], newer("processing_status", "last_status"),
        newer("ai_model_used", "last_model"), newer("processing_started_at", "first_processing_at", keep_old=True),
        newer("processing_completed_at", "closed_at"), newer("updated_at", "last_at"))


def dedupe_documents(documents: DataFrame) -> DataFrame:
    """Keep the newest document of each file name; unnamed documents all stay.

    Only the id of each name's newest document is aggregated, so document texts
    are never shuffled to a name's task.
    """
    alone = F.when(F.col("original_filename").isNull(), F.col("id")).alias("_alone")
    keep = documents.groupBy("original_filename", alone).agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))
    return documents.join(keep.select("id"), "id", "left_semi")


def orphan_requirements(requirements: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requirements of a job that does not exist; without a job id they are no orphans."""
    return requirements.where(F.col("job_id").isNotNull()).join(
        jobs.select(F.col("id").alias("job_id")), "job_id", "left_anti").select(*requirements.columns)


def orphan_jobs(jobs: DataFrame, requirements: DataFrame) -> DataFrame:
    """Jobs that are not pending and own no requirements."""
    owners = requirements.where(F.col("job_id").isNotNull()).select(F.col("job_id").alias("id")).distinct()
    pending = F.coalesce(F.col("processing_status") == "pending", F.lit(False))
    return jobs.where(~pending).join(owners, "id", "left_anti")


def remove_orphans(requirements: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without orphans; jobs are judged by the requirements that remain."""
    known = jobs.select(F.col("id").alias("job_id"))
    left = requirements.where(F.col("job_id").isNull()).unionByName(
        requirements.where(F.col("job_id").isNotNull()).join(known, "job_id", "left_semi")
        .select(*requirements.columns))
    return left, jobs.join(orphan_jobs(jobs, left).select("id"), "id", "left_anti")


def delete_children(children: DataFrame, deleted_parents: DataFrame, foreign_key: str) -> DataFrame:
    """Children whose parent was not deleted; a null foreign key stays."""
    gone = deleted_parents.select(F.col("id").alias(foreign_key))
    return children.join(gone, foreign_key, "left_anti").select(*children.columns)


def touched(table: DataFrame, hit: Column, now: Column) -> DataFrame:
    """``updated_at`` set to ``now`` in the rows that a change hits."""
    return table.withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at")))


def toggle_experiment(experiments: DataFrame, experiment_id: object, active: bool, now: Column | None = None) -> DataFrame:
    """One experiment switched on or off; with ``now`` the row's ``updated_at`` follows where it changes."""
    hit = F.coalesce(F.col("id") == experiment_id, F.lit(False))
    if now is not None:
        experiments = touched(experiments, hit & ~F.col("is_active").eqNullSafe(F.lit(active)), now)
    return experiments.withColumn("is_active", F.when(hit, F.lit(active)).otherwise(F.col("is_active")))


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is false or unknown."""
    return table.where(~F.coalesce(condition, F.lit(False)))


def append_rows(old: DataFrame, new: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """``old`` and ``new``; what ``new`` lacks, or has as null where a default is given, gets the default or null."""
    def filled(c: str) -> Column:
        own = [F.col(c)] if c in new.columns else []
        return F.coalesce(*own, defaults[c]) if c in defaults else own[0] if own else F.lit(None)

    return old.unionByName(new.select(*[filled(c).cast(old.schema[c].dataType).alias(c) for c in old.columns]))


def record_tests(old: DataFrame, new: DataFrame, batch_id: str | None = None) -> DataFrame:
    """Append test rows; a failed run scores zero, and the location score of others is full unless said.

    Where the table has ``test_batch_id``, rows without one get ``batch_id``, or a batch of their own
    named by a hash of the run.
    """
    ok = F.coalesce(F.col("extraction_success"), F.lit(True)) if "extraction_success" in new.columns else F.lit(True)
    scores = ("overall_accuracy_score", "zone_identification_accuracy", "field_extraction_accuracy")
    defaults = {s: F.when(~ok, F.lit(0.0)) for s in scores if s in old.columns}
    defaults |= {"location_extraction_accuracy": F.when(~ok, F.lit(0.0)).otherwise(1.0), "test_epoch": F.lit(1), "extraction_success": F.lit(True)}
    if "test_batch_id" in old.columns:
        run = [c for c in ("prompt_experiment_id", "ground_truth_doc_id", "part_id", "test_epoch", "test_date") if c in new.columns]
        own = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in run]), 256)
        defaults["test_batch_id"] = own if batch_id is None else F.lit(batch_id)
    return append_rows(old, new, defaults)


def add_experiments(old: DataFrame, new: DataFrame) -> DataFrame:
    """Append prompts: active, no baseline, version 1.0, nothing tested yet."""
    return append_rows(old, new, {"is_active": F.lit(True), "is_baseline": F.lit(False), "prompt_version": F.lit("1.0"),
                                  "total_tests": F.lit(0), "successful_extractions": F.lit(0), "failed_extractions": F.lit(0)})


def add_gt_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """Append verified documents: of medium complexity and the default state unless said."""
    return append_rows(old, new, {"document_complexity": F.lit("medium"), "state": F.lit(fv.DEFAULT_STATE)})


def register_documents(files: DataFrame) -> DataFrame:
    """Document rows for admitted files: unique stored name, state and status defaults."""
    key = F.sha2(F.concat_ws("|", F.col("id").cast("string"), "original_filename"), 256)
    suffix = F.lower(F.regexp_extract("original_filename", r"\.([^.]+)$", 1))
    return files.select(
        key.alias("document_key"), F.concat(key, F.lit("."), suffix).alias("filename"), "original_filename",
        "file_size", F.coalesce(F.nullif(F.col("municipality"), F.lit("")), F.lit("Unknown")).alias("municipality"),
        F.coalesce(F.nullif(F.col("state"), F.lit("")), F.lit(fv.DEFAULT_STATE)).alias("state"),
        F.lit("uploaded").alias("processing_status"))


def admit_files(files: DataFrame, suffixes: list[str] = fv.ALLOWED_SUFFIXES,
                max_bytes: int = fv.MAX_FILE_BYTES) -> DataFrame:
    """Every file with ``reject_reason``, null when it is admitted."""
    suffix = F.lower(F.regexp_extract("original_filename", r"\.([^.]+)$", 1))
    return files.withColumn("reject_reason", F.when(~suffix.isin(suffixes), F.lit("suffix")).when(
        F.col("file_size") > max_bytes, F.lit("size")))


def retry_outcomes(attempts: DataFrame, max_attempts: int = fv.MAX_ATTEMPTS) -> DataFrame:
    """What became of each file: processed, failed after the last attempt, or to be retried."""
    facts = attempts.groupBy("path").agg(
        F.min(F.when(F.col("ok"), F.col("attempt_no"))).alias("first_success"),
        F.max("attempt_no").alias("attempts_made"))
    return facts.select(
        "path", "first_success", "attempts_made",
        F.when(F.col("first_success") <= max_attempts, F.lit("processed"))
        .when(F.col("attempts_made") >= max_attempts, F.lit("failed")).otherwise(F.lit("retry")).alias("status"))
