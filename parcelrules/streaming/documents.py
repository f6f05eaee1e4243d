"""The flow of a document: text, extraction, job, requirement rows and states; and uploads that are tried again.

``process_documents`` takes uploaded documents with what the extraction service said and keeps four
tables in step through a ledger: ``documents`` (state after each run), ``jobs`` (one per place, the
first document wins), ``requirements`` (rows by key) and the incoming rows themselves.

``take_uploads`` reads new files and keeps what became of each: a file whose reading fails is held with
its content and tried again, up to a number of attempts, by ``retry_uploads``; counts and contents live in the
ledger, so a restart forgets nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parcelrules import fixed_values as fv
from parcelrules.operators import maintenance, responses
from parcelrules.streaming import flows
from parcelrules.streaming.ledger import Ledger

NO_TEXT = "Failed to extract text from document"
INCOMING = ("id long, original_filename string, municipality string, county string, state string, text string, response_text string, "
            "error string, created_at timestamp_ntz, processed_at timestamp_ntz")
DOCUMENTS = ("id long, processing_status string, error_message string, response_text string, job_id string, requirement_count long, "
             "processing_started_at timestamp_ntz, processing_completed_at timestamp_ntz")
JOBS = ("id string, document_id long, town string, county string, state string, processing_status string, ai_model_used string, "
        "processing_started_at timestamp_ntz, processing_completed_at timestamp_ntz")
REQUIREMENTS = ("response_id long, position int, job_id string, town string, county string, state string, zone string, "
                + ", ".join(f"{f} {'int' if f in fv.INTEGER_FIELDS else 'double'}" for f in fv.RULE_FIELDS)
                + ", max_height_stories_exact double, data_source string, extraction_confidence double, extracted_at timestamp_ntz")
PLACE = ["town", "county", "state"]


def document_ledger(spark: SparkSession, base: str) -> Ledger:
    return Ledger(spark, base, {"incoming": INCOMING, "documents": DOCUMENTS, "jobs": JOBS, "requirements": REQUIREMENTS})


def job_key() -> Column:
    return F.sha2(F.to_json(F.struct(*PLACE)), 256)


def process_batch(ledger: Ledger, model: str) -> Callable[[DataFrame, int], None]:
    """One micro-batch of documents: all tables, then the commit.

    A document without text, or for which the service reported an error, fails with that message and
    has no job. The others complete. The first of a place, over all batches, opens its job, which
    completes with the rows its response gives; a later one of the same place is turned
    away by the job table and gives no rows. Of a document that comes twice in a batch the last run counts.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        if ledger.holds("documents", batch_id):
            return
        number = ledger.next()
        came = ledger.write("incoming", number, batch)
        came = maintenance.latest_per_key(came, ["id"], ["processed_at"])
        failure = F.when(F.coalesce(F.col("text"), F.lit("")) == "", F.lit(NO_TEXT)).otherwise(F.col("error"))
        judged = came.withColumn("failure", failure)
        ready = judged.where("failure IS NULL")
        opened = maintenance.create_jobs(ready, ledger.read("jobs")).where("accepted").select("document_id", *PLACE, job_key().alias("id"))
        runs = opened.join(ready.select(F.col("id").alias("document_id"), "processed_at", "created_at"), "document_id")
        jobs = ledger.write("jobs", number, runs.select(
            "id", "document_id", *PLACE, F.lit("completed").alias("processing_status"), F.lit(model).alias("ai_model_used"),
            F.col("created_at").alias("processing_started_at"), F.col("processed_at").alias("processing_completed_at")))
        said = ready.join(jobs.select(F.col("document_id").alias("id"), F.col("id").alias("job_id")), "id").select(
            F.col("id").alias("response_id"), "job_id", "municipality", "county", "state", F.col("original_filename").alias("filename"),
            "processed_at", "response_text")
        rows = ledger.write("requirements", number, responses.normalize(said))
        counts = rows.groupBy(F.col("response_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
        own = jobs.select(F.col("document_id").alias("id"), F.col("id").alias("job_id"))
        ok = F.col("failure").isNull()
        ledger.write("documents", number, judged.join(own, "id", "left").join(counts, "id", "left").select(
            "id", F.when(ok, "completed").otherwise("failed").alias("processing_status"), F.col("failure").alias("error_message"),
            F.when(ok, F.col("response_text")).alias("response_text"), "job_id", F.coalesce("n", F.lit(0).cast("long")).alias("requirement_count"),
            F.col("created_at").alias("processing_started_at"), F.col("processed_at").alias("processing_completed_at")))
        ledger.commit(number, "documents", batch_id)

    return run


def process_documents(stream: DataFrame, base: str, checkpoint: str, model: str, poll: str | None = None):
    """Run the flow on a stream of documents (the columns of ``INCOMING``)."""
    return flows.run_batches(stream, checkpoint, process_batch(document_ledger(stream.sparkSession, base), model), poll)


def current_documents(ledger: Ledger) -> DataFrame:
    """Each document's state after its last run."""
    return maintenance.latest_per_key(ledger.read("documents"), ["id"], ["_commit", "processing_completed_at"])


def current_requirements(ledger: Ledger) -> DataFrame:
    """The last write of each key, with the time the key was first and last written."""
    rows = ledger.read("requirements")
    times = rows.groupBy(*maintenance.UPSERT_KEY).agg(F.min("extracted_at").alias("created_at"), F.max("extracted_at").alias("updated_at"))
    return maintenance.latest_per_key(rows, maintenance.UPSERT_KEY, flows.WRITE_ORDER).join(times, maintenance.UPSERT_KEY)


def compact_documents(ledger: Ledger) -> None:
    """A snapshot of the tables; of documents and requirements, all runs stay, so that times and repeats are kept."""
    ledger.compact({"incoming": lambda rows: rows.where("false")})


# --- uploads ----------------------------------------------------------------------------

UPLOADS = {"attempts": "path string, attempt_no int, ok boolean", "texts": "path string, text string",
           "held": "path string, content binary"}


def upload_ledger(spark: SparkSession, base: str) -> Ledger:
    return Ledger(spark, base, UPLOADS)


def _record(ledger: Ledger, source: str, batch: int, tried: DataFrame, first: bool) -> None:
    """``tried``: path, content, attempt_no, text (null: it failed)."""
    number = ledger.next()
    attempts = ledger.write("attempts", number, tried.select("path", "attempt_no", F.col("text").isNotNull().alias("ok")))
    ledger.write("texts", number, tried.where("text IS NOT NULL").select("path", "text"))
    held = tried.select("path", "content")
    ledger.write("held", number, held.join(attempts.where("NOT ok").select("path"), "path", "left_semi") if first else held.where("false"))
    ledger.commit(number, source, batch)


def take_uploads(stream: DataFrame, base: str, checkpoint: str, read: Callable[[Column, Column], Column], poll: str | None = None):
    """New files (path, content), each tried once; ``read(content, attempt number)`` gives its text or null."""
    ledger = upload_ledger(stream.sparkSession, base)

    def run(batch: DataFrame, batch_id: int) -> None:
        if not ledger.holds("files", batch_id):
            tried = batch.select("path", "content", F.lit(1).alias("attempt_no"), read(F.col("content"), F.lit(1)).alias("text"))
            _record(ledger, "files", batch_id, tried, True)

    return flows.run_batches(stream, checkpoint, run, poll)


def upload_states(ledger: Ledger, most: int = fv.MAX_ATTEMPTS) -> DataFrame:
    """path, first_success, attempts_made and status: processed, failed, or retry."""
    return maintenance.retry_outcomes(ledger.read("attempts"), most)


def retry_uploads(spark: SparkSession, base: str, read: Callable[[Column, Column], Column], most: int = fv.MAX_ATTEMPTS) -> int:
    """Try the files that failed so far again, round by round, until each is processed or has failed ``most`` times; the rounds run.

    A round is a commit of its own, so one that was cut short is run again and counts once.
    """
    ledger = upload_ledger(spark, base)
    for done in range(most):
        open_ = upload_states(ledger, most).where("status = 'retry'").select("path", (F.col("attempts_made") + 1).alias("attempt_no"))
        if open_.isEmpty():
            return done
        tried = ledger.read("held").select("path", "content").join(open_, "path").withColumn("text", read(F.col("content"), F.col("attempt_no")))
        _record(ledger, "rounds", ledger.state()["sources"].get("rounds", -1) + 1, tried, False)
    return most
