"""Files, sinks and streams as named queries. Work folders are shared ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelrules.operators import responses
from parcelrules.plans import reports
from parcelrules.plans.registry import query, rounded, CHECK_SQL
from parcelrules.plans.suite_reports import AS_OF
from parcelrules.session import work_folder
from parcelrules.sources import bindings, files, responses as src, sinks
from parcelrules.plans.suite_responses import NORMAL_TYPES, ZONES_CHECK
from parcelrules.streaming import documents as flow, flows

# Files hold many texts, in no order: their lines are compared as a sum of hashes.
TEXT_SQL = """
    WITH lines AS (SELECT source, lang, unnest(string_split(text, chr(10))) AS line FROM documents),
    hashed AS (SELECT source, lang, CAST(sum(CAST('0x' || substr(md5(line), 1, 8) AS BIGINT)) AS BIGINT) AS line_hash
               FROM lines WHERE line <> '' GROUP BY 1, 2)
    SELECT d.source, d.lang, 'txt' AS suffix, FALSE AS needs_parser, CAST(sum(length(text) + 1) AS BIGINT) AS characters,
           any_value(line_hash) AS line_hash
    FROM documents d JOIN hashed h ON d.source = h.source AND d.lang = h.lang GROUP BY 1, 2"""


def _text_folder(t):
    folder = work_folder(t.spark, "texts")
    files.write_text_files(t.documents, folder, ["source", "lang"])
    return folder


def _by_source(texts):
    part = lambda key: F.regexp_extract("path", f"/{key}=([^/]+)/", 1)
    hashes = F.transform(F.filter(F.split("text", "\n"), lambda line: line != ""),
                         lambda line: F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint"))
    return texts.groupBy(part("source").alias("source"), part("lang").alias("lang"), "suffix", "needs_parser").agg(
        F.sum(F.length("text")).cast("bigint").alias("characters"),
        F.sum(F.aggregate(hashes, F.lit(0).cast("bigint"), lambda s, x: s + x)).alias("line_hash"))


@query("scan_documents", TEXT_SQL)
def scan_documents(t):
    return _by_source(files.scan_documents(t.spark, _text_folder(t)))


@query("stream_ingest", TEXT_SQL)
def stream_ingest(t):
    base = work_folder(t.spark, "ingest")
    flows.ingest(t.spark, _text_folder(t), f"{base}/documents", f"{base}/attempts", f"{base}/checkpoint")
    return _by_source(t.spark.read.parquet(f"{base}/documents"))


REJECT_SQL = "SELECT 'suffix' AS reject_reason, count(DISTINCT s_nationkey) AS files FROM supplier"


def _mixed_folder(t):
    """The texts, and a file of another kind for each nation."""
    folder = _text_folder(t)
    t.supplier.repartition("s_nationkey").write.partitionBy("s_nationkey").json(f"{folder}/other")
    return folder


def _by_reason(rejects):
    return rejects.where(F.col("path").contains("/s_nationkey=")).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("files"))


@query("scan_rejects", REJECT_SQL)
def scan_rejects(t):
    return _by_reason(files.rejected_documents(t.spark, _mixed_folder(t)))


@query("stream_rejects", REJECT_SQL)
def stream_rejects(t):
    base = work_folder(t.spark, "ingest")
    flows.ingest_rejects(t.spark, _mixed_folder(t), f"{base}/rejects", f"{base}/checkpoint")
    return _by_reason(t.spark.read.parquet(f"{base}/rejects"))


@query("envelope", "SELECT doc_id, md5(text) AS text_md5, 0 AS zones, 0.5 AS extraction_confidence FROM documents",
       types={"extraction_confidence": "DOUBLE", "zones": "INTEGER"})
def envelope(t):
    body = F.parse_json(responses.envelope(F.col("text")))
    return t.documents.select("doc_id", F.md5(F.variant_get(body, "$.raw_response", "string")).alias("text_md5"),
                              F.size(F.variant_get(body, "$.zones", "array<variant>")).alias("zones"),
                              F.variant_get(body, "$.extraction_confidence", "double").alias("extraction_confidence"))


def _report(t):
    return rounded(reports.accuracy_timeline(t.tests, t.experiments, AS_OF))


@query("csv_sink", CHECK_SQL["accuracy_timeline"])
def csv_sink(t):
    report, folder = _report(t), work_folder(t.spark, "csv")
    sinks.write_csv(report, folder)
    return sinks.read_csv(t.spark, folder, report.schema)


@query("json_sink", CHECK_SQL["accuracy_timeline"])
def json_sink(t):
    report, folder = _report(t), work_folder(t.spark, "json")
    sinks.write_json(report, folder)
    return sinks.read_json(t.spark, folder, report.schema)


@query("snapshot", "SELECT * FROM requirements", ("requirements",))
def snapshot(t):
    folder = work_folder(t.spark, "snapshot")
    sinks.write_snapshot(t.requirements, folder)
    return sinks.read_snapshot(t.spark, folder, t.requirements.schema)


@query("stream_normalize", CHECK_SQL["normalize_upsert"])
def stream_normalize(t):
    base = work_folder(t.spark, "responses")
    made = src.extraction_responses(t.spark, t.folder)
    made.write.parquet(f"{base}/in")
    flows.normalize_stream(flows.parquet_stream(t.spark, f"{base}/in", made.schema), f"{base}/out", f"{base}/checkpoint")
    return rounded(flows.current_requirements(t.spark, f"{base}/out"))


@query("stream_stats", """
    SELECT prompt_experiment_id AS id, count(*) AS total_tests,
           count(*) FILTER (WHERE extraction_success) AS successful_extractions,
           count(*) FILTER (WHERE NOT extraction_success) AS failed_extractions,
           round(avg(overall_accuracy_score), 9) AS average_accuracy_score,
           round(avg(field_extraction_accuracy), 9) AS average_field_accuracy,
           round(avg(zone_identification_accuracy), 9) AS average_zone_accuracy, max(test_date) AS last_tested_at
    FROM tests GROUP BY 1""", ("tests",))
def stream_stats(t):
    base = work_folder(t.spark, "stats")
    lines = flows.parquet_stream(t.spark, t.folder, t.lineitem.schema, "lineitem.parquet")
    tests = t.spark.sql(bindings.BINDINGS["tests"], lineitem=lines)
    flows.stats_stream(tests, f"{base}/partials", f"{base}/checkpoint")
    return rounded(flows.merge_stats(t.spark.read.parquet(f"{base}/partials")))


# Documents by time of processing, in three parts, as they come in.
PARTS = (0, 234, 468, 700)
FLOW_CHECK = f"""{ZONES_CHECK},
    d AS (SELECT DISTINCT r AS id, CASE WHEN r % 8 = 0 THEN ' Mytown ' WHEN r % 8 = 1 THEN 'unknown'
                 ELSE 'Unknown_file ' || CAST(r AS VARCHAR) || '_v1_pdf' END AS town, CASE WHEN r % 16 = 0 THEN 'Mycounty' ELSE '' END AS county,
                 CASE WHEN r % 9 = 2 THEN 'Failed to extract text from document' WHEN r % 9 = 5 THEN 'Request timed out' END AS error_message,
                 TIMESTAMP '2024-01-01 00:00:00' + (r % 700) * INTERVAL '1' MINUTE AS done_at FROM f),
    j AS (SELECT *, row_number() OVER (PARTITION BY town, county ORDER BY done_at, id) = 1 AS opens FROM d WHERE error_message IS NULL),
    taken AS (SELECT n.* FROM n JOIN j ON n.response_id = j.id WHERE opens)"""


def _flow(t):
    """The documents of each part come in and are processed; then a part's batch is sent again, and the tables are compacted."""
    base = work_folder(t.spark, "documents")
    made = src.uploaded_documents(t.spark, t.folder)
    minute = F.timestamp_diff("MINUTE", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("processed_at"))
    ledger = flow.document_ledger(t.spark, f"{base}/tables")
    for number, (low, high) in enumerate(zip(PARTS[:-1], PARTS[1:])):
        part = made.where((minute >= low) & (minute < high))
        part.write.parquet(f"{base}/in/part={number}")
        flow.process_documents(flows.parquet_stream(t.spark, f"{base}/in/part=*", made.schema), f"{base}/tables", f"{base}/checkpoint", "rules-1")
        if number == 1:
            flow.compact_documents(ledger)
    flow.process_batch(ledger, "rules-1")(t.spark.read.schema(made.schema).parquet(f"{base}/in/part=1"), 1)
    return ledger


@query("stream_documents", f"""WITH {FLOW_CHECK}
    SELECT d.id, CASE WHEN d.error_message IS NULL THEN 'completed' ELSE 'failed' END AS processing_status, d.error_message,
           CASE WHEN opens THEN j.town END AS job_town, CASE WHEN opens THEN j.county END AS job_county, CASE WHEN opens THEN 'completed' END AS job_status,
           CASE WHEN opens THEN d.done_at END AS job_completed_at, (SELECT count(*) FROM taken WHERE response_id = d.id) AS requirement_count
    FROM d LEFT JOIN j USING (id)""")
def stream_documents(t):
    ledger = _flow(t)
    jobs = ledger.read("jobs").select(F.col("id").alias("job_id"), F.col("town").alias("job_town"), F.col("county").alias("job_county"),
                                      F.col("processing_status").alias("job_status"), F.col("processing_completed_at").alias("job_completed_at"))
    return flow.current_documents(ledger).join(jobs, "job_id", "left").select(
        "id", "processing_status", "error_message", "job_town", "job_county", "job_status", "job_completed_at", "requirement_count")


@query("stream_document_requirements", f"""WITH {FLOW_CHECK},
    u AS (SELECT * EXCLUDE (job_id), min(extracted_at) OVER (PARTITION BY town, county, state, zone) AS created_at, max(extracted_at) OVER
          (PARTITION BY town, county, state, zone) AS updated_at, row_number() OVER (PARTITION BY town, county, state, zone
          ORDER BY extracted_at DESC, response_id DESC, position DESC) AS rn FROM taken)
    SELECT * EXCLUDE (rn) FROM u WHERE rn = 1""", types=NORMAL_TYPES)
def stream_document_requirements(t):
    return rounded(flow.current_requirements(_flow(t)).drop("job_id", "_commit"))


# A file is read at once, after one or two more attempts, or never, as its length in bytes says.
DOCS_IN_FILE = 50
# Of files in a batch: what the cluster works off in a few seconds, whatever the size of one file.
UPLOAD_BYTES = 256 << 20


@query("stream_retries", f"""
    WITH g AS (SELECT CAST(floor(doc_id / {DOCS_IN_FILE}) AS BIGINT) AS part, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents GROUP BY 1)
    SELECT part, CAST(CASE WHEN bytes % 4 = 3 THEN 3 ELSE bytes % 4 + 1 END AS INTEGER) AS attempts_made,
           CASE WHEN bytes % 4 = 3 THEN 'failed' ELSE 'processed' END AS status, CASE WHEN bytes % 4 <> 3 THEN bytes END AS text_bytes FROM g""")
def stream_retries(t):
    base, folder = work_folder(t.spark, "uploads"), work_folder(t.spark, "texts")
    part = F.floor(F.col("doc_id") / DOCS_IN_FILE).alias("part")
    t.documents.select(part, "text").repartition("part").write.partitionBy("part").text(folder)
    read = lambda content, attempt: F.when(F.octet_length(content) % 4 < attempt, files.text_of(content))
    flow.take_uploads(flows.file_stream(t.spark, folder, glob="*.txt", bytes_per_batch=UPLOAD_BYTES), f"{base}/tables", f"{base}/checkpoint", read)
    flow.retry_uploads(t.spark, f"{base}/tables", read)
    ledger = flow.upload_ledger(t.spark, f"{base}/tables")
    ledger.compact()
    sizes = ledger.read("texts").select("path", F.octet_length("text").cast("long").alias("text_bytes"))
    return flow.upload_states(ledger).join(sizes, "path", "left").select(
        F.regexp_extract("path", "/part=([0-9]+)/", 1).cast("long").alias("part"), "attempts_made", "status", "text_bytes")
