"""Maintenance, streams and files against brute force on small inputs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parcelrules.operators import guarded, maintenance as m, quality, stats
from parcelrules.sources import files, footers, sinks
from parcelrules.streaming import flows

T0 = datetime(2024, 1, 1)


def test_status_events_match_one_by_one_updates(spark):
    rng = random.Random(7)
    docs = [(i, rng.choice(["uploaded", "processing", "failed"])) for i in range(60)]
    events = []
    for e in range(400):
        action = rng.choice(["start", "update", "update"])
        status = rng.choice(["processing", "completed", "failed"]) if action == "update" else None
        events.append((e, rng.randrange(50), T0 + timedelta(minutes=rng.randrange(100)), action, status,
                       f"r{e}" if action == "update" and rng.random() < .3 else None,
                       f"e{e}" if action == "update" and rng.random() < .3 else None))
    want = {i: [s, None, None, None, None, None] for i, s in docs}
    for e, i, at, action, status, said, error in sorted(events, key=lambda x: (x[2], x[0])):
        row = want[i]
        if action == "start":
            if row[0] == "uploaded":
                row[0], row[1], row[5] = "processing", at, at
        else:
            row[0], row[5] = status, at
            row[2] = at if status in ("completed", "failed") else row[2]
            row[3], row[4] = said or row[3], error or row[4]
    got = m.apply_document_events(
        spark.createDataFrame(docs, "id int, processing_status string"),
        spark.createDataFrame(events, "event_id int, document_id int, event_at timestamp_ntz, action string, "
                                      "status string, response_text string, error_message string"))
    columns = ["processing_status", "processing_started_at", "processing_completed_at", "response_text",
               "error_message", "updated_at"]
    assert {r.id: [r[c] for c in columns] for r in got.collect()} == want


def test_job_events(spark):
    jobs = spark.createDataFrame([(1, "pending", None, None, None, None), (2, "pending", None, None, None, None)],
                                 "id int, processing_status string, ai_model_used string, processing_started_at "
                                 "timestamp, processing_completed_at timestamp, updated_at timestamp")
    at = [T0 + timedelta(hours=h) for h in range(4)]
    events = spark.createDataFrame([(1, 1, at[0], "processing", "m1"), (2, 1, at[1], "processing", None),
                                    (3, 1, at[2], "completed", None)],
                                   "event_id int, job_id int, event_at timestamp, status string, ai_model_used string")
    one, two = m.apply_job_events(jobs, events).orderBy("id").collect()
    assert tuple(one)[1:] == ("completed", "m1", at[0], at[2], at[2])
    assert tuple(two)[1:] == ("pending", None, None, None, None)


def test_upsert_keeps_rows_with_a_null_key_part(spark):
    schema = "id int, town string, county string, state string, zone string, v int, created_at timestamp"
    old = spark.createDataFrame([(1, "T", None, "NJ", "A", 1, T0), (2, "T", "C", "NJ", "A", 1, T0)], schema)
    new = spark.createDataFrame([(3, "T", None, "NJ", "A", 2, T0), (4, "T", "C", "NJ", "A", 2, T0),
                                 (5, "T", "C", "NJ", "A", 3, T0)], schema)
    assert sorted((r.id, r.v) for r in m.upsert(old, new).collect()) == [(1, 1), (3, 2), (5, 3)]
    assert sorted((r.id, r.v) for r in m.upsert_keep_created(old, new).collect()) == [(1, 1), (2, 3), (3, 2)]


def test_a_hot_key_is_reduced_before_the_shuffle(spark, folder):
    """One key with a third of all rows: winners come from partial aggregates, no window."""
    rows = spark.range(30000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"),
        (F.col("id") * 7919 % 30000).alias("o"))
    won = m.latest_per_key(rows, ["k"], ["o"])
    plan = won._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_max_by" in plan
    assert won.count() == 20001
    assert won.where("k = 'hot'").first().o == 29997


def test_create_jobs_takes_the_first_and_keeps_the_rest(spark):
    docs = spark.createDataFrame([(1, "a.b.pdf", None, None, T0), (2, "x.pdf", "Town", None, T0),
                                  (3, "y.pdf", "Town", "NY", T0), (4, "z.pdf", "Town", None, T0 - timedelta(1))],
                                 "id int, original_filename string, municipality string, state string, created_at timestamp")
    got = {r.document_id: (r.town, r.state, r.accepted) for r in m.create_jobs(docs).collect()}
    assert got == {1: ("Unknown_a_b_pdf", "NJ", True), 2: ("Town", "NJ", False), 3: ("Town", "NY", True),
                   4: ("Town", "NJ", True)}
    jobs = spark.createDataFrame([("Town", "", "NJ")], "town string, county string, state string")
    again = {r.document_id: r.accepted for r in m.create_jobs(docs, jobs).collect()}
    assert again == {1: True, 2: False, 3: True, 4: False}


def test_orphans_and_null_jobs(spark):
    req = spark.createDataFrame([(1, 10), (2, None), (3, 99)], "id int, job_id int")
    jobs = spark.createDataFrame([(10, "completed"), (11, "pending"), (12, "failed"), (13, None)],
                                 "id int, processing_status string")
    assert [r.id for r in m.orphan_requirements(req, jobs).collect()] == [3]
    kept, left = m.remove_orphans(req, jobs)
    assert sorted(r.id for r in kept.collect()) == [1, 2]
    assert sorted(r.id for r in left.collect()) == [10, 11]


def test_checks_pass_on_unknown(spark):
    df = spark.createDataFrame([(1, 50.0), (2, None), (3, 101.0)], "id int, max_lot_coverage_percent double")
    checks = quality.rules("requirements", df.columns)
    assert [tuple(r) for r in quality.violations(df, checks, ["id"]).collect()] == [
        (3, "max_lot_coverage_percent within 0..100")]
    assert quality.passing(df, checks).count() == 2


def test_summary_of_untested_experiments(spark):
    exp = spark.createDataFrame([(1, "a", "1", True, T0)], "id int, prompt_name string, prompt_version string, "
                                                           "is_baseline boolean, created_at timestamp")
    tests = spark.createDataFrame([], "prompt_experiment_id int, test_date timestamp, overall_accuracy_score double")
    row = stats.test_summary(exp, tests, T0, T0).first()
    assert tuple(row) == (1, 0, None, None, 0.0)


def test_text_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes("Zone R-1 ½".encode() + b"\xff\xfe" + b" end")
    (tmp_path / "in" / "b.PDF").write_bytes(b"%PDF")
    (tmp_path / "in" / "c.exe").write_bytes(b"MZ")
    got = {r.suffix: (r.text, r.needs_parser) for r in files.scan_documents(spark, str(tmp_path / "in")).collect()}
    assert got == {"txt": ("Zone R-1 ½ end", False), "pdf": (None, True)}
    gone = files.rejected_documents(spark, str(tmp_path / "in"))
    assert [(r.path.rsplit("/", 1)[1], r.reject_reason) for r in gone.collect()] == [("c.exe", "suffix")]
    listed = files.list_files(spark, str(tmp_path / "in"))
    assert {r.name: r.type for r in listed.collect()} == {"a.txt": "txt", "b.PDF": "pdf", "c.exe": "exe"}
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString()


def test_ingest_sees_a_file_once_and_retries_are_durable(spark, tmp_path):
    source, target, attempts, check = (str(tmp_path / n) for n in ("in", "out", "attempts", "check"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one")
    (tmp_path / "in" / "b.pdf").write_text("%PDF")
    flows.ingest(spark, source, target, attempts, check)
    (tmp_path / "in" / "c.txt").write_text("three")
    flows.ingest(spark, source, target, attempts, check)
    docs = spark.read.parquet(target)
    assert sorted(r.text for r in docs.where("not needs_parser").collect()) == ["one", "three"]
    for n in (2, 3, 4):
        flows.retry_round(spark, attempts, n, lambda paths: paths.withColumn("ok", F.lit(False)))
    outcome = {r.path.rsplit("/", 1)[1]: (r.status, r.attempts_made)
               for r in m.retry_outcomes(spark.read.parquet(attempts)).collect()}
    assert outcome == {"a.txt": ("processed", 1), "b.pdf": ("failed", 3), "c.txt": ("processed", 1)}


def test_a_batch_reads_admitted_files_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("one")
    (source / "b.exe").write_text("two")
    (source / "c.TXT").write_text("three")
    args = [str(tmp_path / n) for n in ("out", "attempts", "check")]
    query = flows.ingest(spark, str(source), *args)
    # The source hands on the two admitted files only, in one read.
    assert sum(p["numInputRows"] for p in query.recentProgress) == 2
    assert sorted(r.text for r in spark.read.parquet(args[0]).collect()) == ["one", "three"]
    flows.ingest_rejects(spark, str(source), str(tmp_path / "gone"), str(tmp_path / "check2"))
    rows = spark.read.parquet(str(tmp_path / "gone")).collect()
    assert [(r.path.rsplit("/", 1)[1], r.reject_reason) for r in rows] == [("b.exe", "suffix")]
    assert "content" not in rows[0].asDict()


def test_keys_with_null_parts_never_meet(spark):
    rows = spark.createDataFrame([("A", None, None, 1), ("A", None, None, 2), ("A", None, 5, 3)], "town string, county string, at int, id int")
    assert m.latest_per_key(rows, ["town", "county"], ["at", "id"]).count() == 3


def test_archived_files(spark, tmp_path):
    source, archive = tmp_path / "in", tmp_path / "done"
    source.mkdir(), archive.mkdir()
    (source / "a.txt").write_text("one")
    args = [str(source), *(str(tmp_path / n) for n in ("out", "attempts", "check")), str(archive)]
    flows.ingest(spark, *args)
    (source / "b.txt").write_text("two")
    flows.ingest(spark, *args)
    flows.ingest(spark, *args)
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["one", "two"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a, "b"\nc', None), (2, "", 2.5)], "i int, s string, x double")
    sinks.write_csv(df, str(tmp_path / "csv"))
    back = sinks.read_csv(spark, str(tmp_path / "csv"), df.schema).orderBy("i").collect()
    assert [(r.i, r.s or "", r.x) for r in back] == [(1, 'a, "b"\nc', None), (2, "", 2.5)]
    sinks.write_json(df, str(tmp_path / "json"))
    assert sinks.read_json(spark, str(tmp_path / "json"), df.schema).orderBy("i").collect() == df.collect()
    sinks.write_csv(df.where("i > 5"), str(tmp_path / "none"))
    assert any("i,s,x" in f.read_text() for f in (tmp_path / "none").glob("part-*"))
    fields = sinks.catalogue(spark, {"jobs_export": df}).orderBy("position").collect()
    assert [(r.field, r.type) for r in fields] == [("i", "int"), ("s", "string"), ("x", "double")]


def test_single_row_lookups(spark, folder):
    from parcelrules.operators import search
    from parcelrules.plans.registry import Tables

    t = Tables(spark, folder)
    one = stats.experiment_results(t.experiments, t.tests, 3).first()
    assert one.total_tests == stats.experiment_tests(t.tests, 3).count() == t.tests.where("prompt_experiment_id = 3").count()
    docs = stats.document_test_results(t.tests, t.experiments, 42)
    assert docs.count() == t.tests.where("ground_truth_doc_id = 42").count()
    assert search.by_id(t.zdocuments, 17).count() == 1
    assert search.gt_requirements_for_doc(t.gt_requirements, 42).first().id == 42


def test_compacted_batches_give_the_same_table(spark, tmp_path):
    from parcelrules import schemas

    source, target, snaps, check = (str(tmp_path / n) for n in ("in", "out", "snaps", "check"))
    for n in range(3):
        said = [(10 * n + i, f"job{n}{i}", "Town", "C", "NJ", "f.pdf", T0 + timedelta(hours=n),
                 f'{{"zones": [{{"zone": "R-{i}", "lot_area": {7000 + n}}}]}}') for i in range(n, n + 2)]
        spark.createDataFrame(said, schemas.RESPONSES).coalesce(1).write.mode("append").parquet(source)
        flows.normalize_stream(flows.parquet_stream(spark, source, schemas.RESPONSES), target, check)
    whole = flows.current_requirements(spark, target)
    assert sorted((r.zone, r.interior_min_lot_area_sqft) for r in whole.collect()) == [
        ("R-0", 7000), ("R-1", 7001), ("R-2", 7002), ("R-3", 7002)]
    flows.compact(spark, target, snaps, 0)
    flows.compact(spark, target, snaps, 1, previous=0)
    later = flows.current_requirements(spark, target, snaps, upto=1)
    assert sorted(map(str, later.collect())) == sorted(map(str, whole.collect()))


def test_merged_partials_and_later_batches(spark, tmp_path):
    target = str(tmp_path / "partials")
    rows = [(1, 2, 3.0), (2, 1, 0.5), (1, 4, 1.0), (3, 1, 2.0)]
    for n, row in enumerate(rows):
        spark.createDataFrame([(*row, T0 + timedelta(hours=n))], "id int, total_tests long, s_x double, last_tested_at timestamp").write.parquet(
            flows.batch_folder(target, n))
        if n in (1, 2):
            flows.compact_batches(spark, target, flows.merge_partials, n)
    got = {r.id: (r.total_tests, r.s_x) for r in flows.merge_partials(flows.compacted(spark, target)).collect()}
    assert got == {1: (6, 4.0), 2: (1, 0.5), 3: (1, 2.0)}
    assert flows.compacted(spark, target).count() == 3


def test_pages_by_key(spark):
    from parcelrules.operators import search

    rows = spark.createDataFrame([("A", i % 3, i) for i in range(9)], "town string, zone int, id int")
    first = rows.orderBy("town", "zone", "id").limit(4).collect()
    rest = search.after(rows, {"town": first[-1].town, "zone": first[-1].zone, "id": first[-1].id})
    assert first + rest.orderBy("town", "zone", "id").collect() == rows.orderBy("town", "zone", "id").collect()
    with pytest.raises(ValueError):
        search.search_requirements(rows, offset=10 ** 6)


def test_pages_by_key_past_the_offset_limit(spark):
    from parcelrules.operators import search

    rows = spark.range(10_500).selectExpr(
        "id", "CASE WHEN id % 50 > 0 THEN timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, id % 7) END AS created_at")
    whole = rows.orderBy(F.desc("created_at"), "id").collect()
    for at in (10_100, 10_400):       # before and among the rows without a time
        last = {"created_at": whole[at].created_at, "id": whole[at].id}
        assert search.search_jobs(rows, limit=60, last=last).collect() == whole[at + 1:at + 61]
        page = search.list_documents(rows, limit=60, last=last).collect()
        assert [(r.id, r.created_at) for r in page] == [(r.id, r.created_at) for r in whole[at + 1:at + 61]]
        assert {r.total for r in page} == {10_500}
    first = rows.where("id < 150").orderBy("created_at", "id").collect()
    rest = search.after(rows.where("id < 150"), {"created_at": None, "id": 50}).orderBy("created_at", "id").collect()
    assert rest == first[2:]


def test_guarded_rows_match_one_by_one_appends(spark):
    rng = random.Random(12)
    kind = "id int, doc int, zone string, size double"
    old = [(i, i % 9, f"z{i // 9}", 1.0) for i in range(27)]
    new = [(100 + i, rng.choice([None, *range(14)]), rng.choice([None, "z0", "z1", "z5", "z6"]), rng.choice([-1.0, None, 2.0])) for i in range(200)]
    held, reasons = {(d, z) for _, d, z, _ in old}, {}
    taken = set(held)
    for i, doc, zone, size in new:
        why = [*(["size not negative"] if size is not None and size < 0 else []), *(["doc unknown"] if doc is not None and doc > 11 else [])]
        if doc is not None and zone is not None:
            if (doc, zone) in held:
                why.append(guarded.TAKEN)
            elif not why and (doc, zone) in taken:
                why.append(guarded.TWICE)
            elif not why:
                taken.add((doc, zone))
        reasons[i] = why
    parents = spark.createDataFrame([(i,) for i in [*range(12), None, 3]], "id int")
    table = spark.createDataFrame(old, kind)
    told = guarded.judged(table, spark.createDataFrame(new, kind), {"size not negative": F.col("size") >= 0}, {"doc": parents},
                          ["doc", "zone"], ["id"])
    assert {r.id: r.reasons for r in told.collect()} == reasons
    assert {w for why in reasons.values() for w in why} == {"size not negative", "doc unknown", guarded.TAKEN, guarded.TWICE}
    good, bad = guarded.append(table, told, {"size": F.lit(0.0)})
    assert {r.id for r in good.collect()} == {r[0] for r in old} | {i for i, why in reasons.items() if not why}
    assert good.where("size IS NULL").count() == 0 and bad.count() == sum(1 for why in reasons.values() if why)
    none = table.limit(0)
    assert guarded.judged(none, none, {}, {"doc": parents}, ["doc", "zone"], ["id"]).count() == 0


def test_failed_runs_score_zero_and_batches_are_named(spark):
    kind = "prompt_experiment_id int, ground_truth_doc_id int, extraction_success boolean, {} test_batch_id string"
    scores = "overall_accuracy_score double, location_extraction_accuracy double, test_epoch int,"
    old = spark.createDataFrame([], kind.format(scores))
    new = spark.createDataFrame([(1, 1, False, None), (1, 2, True, None), (2, 1, None, "mine")], kind.format(""))
    rows = {(r.prompt_experiment_id, r.ground_truth_doc_id): r for r in m.record_tests(old, new).collect()}
    assert (rows[1, 1].overall_accuracy_score, rows[1, 1].location_extraction_accuracy) == (0.0, 0.0)
    assert (rows[1, 2].overall_accuracy_score, rows[1, 2].location_extraction_accuracy) == (None, 1.0)
    assert rows[2, 1].extraction_success and rows[2, 1].test_batch_id == "mine" and rows[1, 1].test_batch_id != rows[1, 2].test_batch_id
    assert {r.test_batch_id for r in m.record_tests(old, new, "b7").collect()} == {"b7", "mine"}


def test_counts_come_from_the_footers(spark, tmp_path):
    rows = [(i, None if i % 3 else f"t{i}") for i in range(50)]
    whole, none = str(tmp_path / "whole"), str(tmp_path / "none")
    spark.createDataFrame(rows, "id int, name string").repartition(4).write.parquet(whole)
    spark.createDataFrame([], "id int, name string").write.parquet(none)
    before = spark.conf.get(footers.V1_SOURCES)
    got = footers.footer_counts(spark, {"whole": (whole, "id", "name"), "none": (none, "id", "name")})
    assert spark.conf.get(footers.V1_SOURCES) == before
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(id), MAX(id), COUNT(name)]" in plan
    assert "ReadSchema: struct<count(*):bigint,min(id):int,max(id):int,count(name):bigint>" in plan
    assert {tuple(r) for r in got.collect()} == {("whole", 50, 0, 49, 17), ("none", 0, None, None, 0)}
