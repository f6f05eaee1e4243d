"""Streams: document files in, responses to requirement rows, running statistics.

Every micro-batch writes its own ``batch_id=N`` folder and overwrites it when the
batch is run again, so a lost executor or a restarted query changes nothing. The
checkpoint is the set of files already seen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from parcelrules import fixed_values as fv
from parcelrules.operators import maintenance, responses
from parcelrules.operators.stats import TEST_MEASURES
from parcelrules.sources import files

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
POLL = "5 seconds"


def run_batches(stream: DataFrame, checkpoint: str, per_batch: Callable[[DataFrame, int], None],
                poll: str | None = None):
    """All available input and stop, or look again every ``poll`` (say, ``POLL``) until stopped."""
    writer = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    query = (writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)).start()
    if not poll:
        query.awaitTermination()
    return query


def batch_folder(target: str, batch_id: int) -> str:
    return f"{target}/batch_id={batch_id}"


def file_stream(spark: SparkSession, folder: str, archive: str | None = None,
                files_per_batch: int | None = None, glob: str = "*", bytes_per_batch: int | None = None) -> DataFrame:
    """New files of a folder, each once; with ``archive`` they are moved there when done.

    A batch has a cost of its own, so many small files go better by ``bytes_per_batch`` than by number.
    """
    reader = (spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true")
              .option("pathGlobFilter", glob))
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    return reader.load(folder)


def admitted_texts(stream: DataFrame) -> DataFrame:
    """Admission and text on the streaming frame itself, so that both reach the source of each batch."""
    return files.as_text(files.admitted(stream)).withColumns({
        "municipality": F.lit("Unknown"), "county": F.lit(""), "state": F.lit("NJ")})


def ingest_batch(target: str, attempts: str) -> Callable[[DataFrame, int], None]:
    """Texts to ``target``, once; the outcome of every file, from what was written, to ``attempts``.

    A file fails when no text can be had from it here (it needs a parser).
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(batch_folder(target, batch_id))
        written = batch.sparkSession.read.schema(batch.schema).parquet(batch_folder(target, batch_id))
        done = written.select("path", F.lit(1).alias("attempt_no"), (~F.col("needs_parser")).alias("ok"))
        done.write.mode("overwrite").parquet(batch_folder(attempts, batch_id))

    return write


def ingest(spark: SparkSession, folder: str, target: str, attempts: str, checkpoint: str,
           archive: str | None = None, poll: str | None = None):
    """New admitted files as text. Files of other kinds are never opened; see :func:`ingest_rejects`."""
    stream = admitted_texts(file_stream(spark, folder, archive, glob=files.suffix_glob(fv.ALLOWED_SUFFIXES)))
    return run_batches(stream, checkpoint, ingest_batch(target, attempts), poll)


def ingest_rejects(spark: SparkSession, folder: str, target: str, checkpoint: str, poll: str | None = None):
    """New files that are not admitted, with their reason; a stream of its own that reads no content."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(batch_folder(target, batch_id))

    return run_batches(files.rejected(file_stream(spark, folder)), checkpoint, write, poll)


def retry_round(spark: SparkSession, attempts: str, round_no: int,
                attempt: Callable[[DataFrame], DataFrame]) -> None:
    """Try files that failed so far once more; ``attempt`` adds ``ok`` to (path, attempt_no).

    Counts live in the attempts table, not in memory, so a restart forgets none.
    """
    log = spark.read.parquet(attempts)
    open_paths = maintenance.retry_outcomes(log).where("status = 'retry'").select(
        "path", (F.col("attempts_made") + 1).alias("attempt_no"))
    outcome = attempt(open_paths).select("path", "attempt_no", "ok")
    outcome.write.mode("overwrite").parquet(f"{attempts}/batch_id=r{round_no}")


def normalize_stream(stream: DataFrame, target: str, checkpoint: str, poll: str | None = None):
    """Responses to requirement rows, one folder per batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        responses.normalize(batch).write.mode("overwrite").parquet(batch_folder(target, batch_id))

    return run_batches(stream, checkpoint, write, poll)


WRITE_ORDER = ["extracted_at", "response_id", "position"]


def compact_batches(spark: SparkSession, target: str, merge: Callable[[DataFrame], DataFrame], upto: int) -> None:
    """Batches up to ``upto`` merged into one folder, beside the batches; :func:`compacted` reads both.

    The merged folder is written whole before it is used, so a run that is cut
    short leaves the old state, and a second run gives the same one.
    """
    merge(compacted(spark, target, last=upto)).write.mode("overwrite").parquet(f"{target}_merged/upto={upto}")


def compacted(spark: SparkSession, target: str, last: int | None = None) -> DataFrame:
    """The newest complete merged folder, the batches after it, and all retry rounds, which are never merged."""
    folders, done = finished_folders(spark, f"{target}_merged", "upto"), -1
    if last is not None:
        folders = [n for n in folders if n < last]
    parts = []
    if folders:
        done = max(folders)
        parts.append(spark.read.parquet(f"{target}_merged/upto={done}"))
    newer = [n for n in finished_folders(spark, target, "batch_id") if n > done and (last is None or n <= last)]
    if newer:
        parts.append(spark.read.parquet(*[batch_folder(target, n) for n in newer]))
    rounds = finished_folders(spark, target, "batch_id", "r") if last is None else []
    if rounds:
        parts.append(spark.read.parquet(*[f"{target}/batch_id=r{n}" for n in rounds]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def finished_folders(spark: SparkSession, base: str, key: str, mark: str = "") -> list[int]:
    """Numbers of the folders ``key=N`` (with ``mark``, ``key=<mark>N``) under ``base`` whose write was committed."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{base}/{key}={mark}*/_SUCCESS")) or []
    names = [status.getPath().getParent().getName().split("=", 1)[1][len(mark):] for status in found]
    return [int(n) for n in names if n.isdigit()]


def current_requirements(spark: SparkSession, target: str, snapshots: str | None = None,
                         upto: int = -1) -> DataFrame:
    """The table now: the last write of each key.

    With the snapshot that holds all batches up to ``upto``, only newer batches
    are read (their folders are pruned by ``batch_id``).
    """
    rows = spark.read.parquet(target).where(F.col("batch_id") > upto).drop("batch_id")
    if snapshots is not None and upto >= 0:
        rows = spark.read.parquet(f"{snapshots}/upto={upto}").unionByName(rows)
    return maintenance.latest_per_key(rows, maintenance.UPSERT_KEY, WRITE_ORDER)


def compact(spark: SparkSession, target: str, snapshots: str, upto: int, previous: int = -1) -> None:
    """Write the snapshot of all batches up to ``upto``, starting from an earlier one."""
    batches = spark.read.parquet(target).where(F.col("batch_id").between(previous + 1, upto)).drop("batch_id")
    if previous >= 0:
        batches = spark.read.parquet(f"{snapshots}/upto={previous}").unionByName(batches)
    maintenance.latest_per_key(batches, maintenance.UPSERT_KEY, WRITE_ORDER).write.mode("overwrite").parquet(
        f"{snapshots}/upto={upto}")


def partial_stats(tests: DataFrame) -> DataFrame:
    """Mergeable statistics per experiment: counts, sums and the latest time."""
    ok = F.col("extraction_success")
    return tests.groupBy(F.col("prompt_experiment_id").alias("id")).agg(
        F.count(F.lit(1)).alias("total_tests"), F.count_if(ok).alias("successful_extractions"),
        F.count_if(~ok).alias("failed_extractions"),
        *[F.sum(c).alias(f"s_{n}") for n, c in TEST_MEASURES.items()],
        *[F.count(c).alias(f"n_{n}") for n, c in TEST_MEASURES.items()],
        F.max("test_date").alias("last_tested_at"))


def merge_partials(partials: DataFrame) -> DataFrame:
    """Partials of one experiment as one partial."""
    sums = [c for c in partials.columns if c not in ("id", "last_tested_at")]
    return partials.groupBy("id").agg(*[F.sum(c).alias(c) for c in sums], F.max("last_tested_at").alias("last_tested_at"))


def merge_stats(partials: DataFrame) -> DataFrame:
    counts = ("total_tests", "successful_extractions", "failed_extractions")
    return partials.groupBy("id").agg(
        *[F.sum(c).alias(c) for c in counts],
        *[F.try_divide(F.sum(f"s_{n}"), F.sum(f"n_{n}")).alias(n) for n in TEST_MEASURES],
        F.max("last_tested_at").alias("last_tested_at"))


def stats_stream(tests: DataFrame, target: str, checkpoint: str, poll: str | None = None):
    """Statistics that follow the tests: each batch adds one small partial per experiment.

    Nothing is kept in streaming state; partials of all batches merge when read.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        partial_stats(batch).write.mode("overwrite").parquet(batch_folder(target, batch_id))

    return run_batches(tests, checkpoint, write, poll)


def parquet_stream(spark: SparkSession, folder: str, schema: StructType, glob: str = "*.parquet",
                   files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)
