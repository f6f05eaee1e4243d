"""Commits of several tables, the document flow and uploads that are tried again."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parcelrules.sources import files
from parcelrules.streaming import documents as flow, flows
from parcelrules.streaming.ledger import Ledger

T0 = datetime(2024, 1, 1)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_commits_show_all_or_nothing(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path), {"a": "x int", "b": "y string"})
    one, two = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([("u",)], "y string")
    assert ledger.read("a").count() == 0
    ledger.write("a", 1, one)                                   # cut short: no commit
    assert ledger.read("a").count() == 0 and ledger.next() == 1 and not ledger.holds("s", 0)
    ledger.write("a", 1, one.withColumn("x", F.lit(7)))
    ledger.write("b", 1, two)
    ledger.commit(1, "s", 0)
    assert rows(ledger.read("a"), "x", "_commit") == [(7, 1)] and rows(ledger.read("b"), "y") == [("u",)] and ledger.holds("s", 0)
    with pytest.raises(ValueError):
        ledger.commit(2, "s", 0)
    for batch in (1, 2):
        ledger.write("a", ledger.next(), one)
        ledger.write("b", ledger.next(), two.where("false"))
        ledger.commit(ledger.next(), "s", batch)
    before = rows(ledger.read("a"), "x")
    ledger.compact({"b": lambda df: df.distinct()})
    assert rows(ledger.read("a"), "x") == before == [(1,), (1,), (7,)] and ledger.state()["commits"] == []
    assert rows(ledger.read("a", version=1), "x") == [(7,)]     # an old version stays readable
    ledger.write("a", 5, one)                                   # not committed yet: vacuum leaves it
    assert ledger.vacuum() == 6 and rows(ledger.read("a"), "x") == before and (tmp_path / "a" / "commit=5").exists()


ANSWER = '{"extracted_town": "Elsewhere", "zoning_requirements": [{"zone": "R-1", "lot_area": %d}, {"zone": "R-2", "far": 2}]}'


def document(i, town, answer, text="text", error=None, minute=0):
    return (i, f"f{i}.txt", town, "C", None, text, answer, error, T0, T0 + timedelta(minutes=minute))


def test_documents_flow(spark, tmp_path):
    base, source = str(tmp_path / "t"), str(tmp_path / "in")
    first = [document(1, "Ames", ANSWER % 4000, minute=1), document(2, "Ames", ANSWER % 9000, minute=2), document(3, "Berg", None, text=None),
             document(4, "Berg", None, error="timed out"), document(5, "Cole", "no rules here", minute=3)]
    second = [document(6, "Berg", ANSWER % 6000, minute=5), document(4, "Dorn", ANSWER % 7000, minute=6), document(7, "Ames", ANSWER % 100, minute=7)]
    ledger = flow.document_ledger(spark, base)

    def send(some, n):
        spark.createDataFrame(some, flow.INCOMING).coalesce(1).write.parquet(f"{source}/part={n}")
        schema = spark.createDataFrame([], flow.INCOMING).schema
        flow.process_documents(flows.parquet_stream(spark, f"{source}/part=*", schema), base, str(tmp_path / "check"), "m")

    def seen():
        return (rows(flow.current_documents(ledger), "id", "processing_status", "requirement_count"), rows(ledger.read("jobs"), "document_id", "town"),
                rows(flow.current_requirements(ledger), "town", "zone", "interior_min_lot_area_sqft") if ledger.next() > 2 else None)

    send(first, 0)
    assert seen()[:2] == ([(1, "completed", 2), (2, "completed", 0), (3, "failed", 0), (4, "failed", 0), (5, "completed", 0)], [(1, "Ames"), (5, "Cole")])
    assert {r.id: r.error_message for r in flow.current_documents(ledger).collect()}[3] == flow.NO_TEXT
    send(second, 1)
    after = seen()
    assert after[0] == [(1, "completed", 2), (2, "completed", 0), (3, "failed", 0), (4, "completed", 2), (5, "completed", 0), (6, "completed", 2), (7, "completed", 0)]
    assert after[1] == [(1, "Ames"), (4, "Dorn"), (5, "Cole"), (6, "Berg")]
    assert [r[:2] for r in after[2]] == [("Ames", "R-1"), ("Ames", "R-2"), ("Berg", "R-1"), ("Berg", "R-2"), ("Dorn", "R-1"), ("Dorn", "R-2")]
    version = ledger.state()
    flow.process_batch(ledger, "m")(spark.createDataFrame(second, flow.INCOMING), 1)      # the batch again
    assert ledger.state() == version and seen() == after
    flow.compact_documents(ledger)
    assert seen() == after and ledger.read("incoming").count() == 0
    flow.process_batch(ledger, "m")(spark.createDataFrame([document(8, "Ames", ANSWER % 1, minute=9)], flow.INCOMING), 2)
    assert rows(ledger.read("jobs"), "document_id") == [(1,), (4,), (5,), (6,)]           # Ames has its job since the snapshot


def test_a_batch_cut_short_runs_again(spark, tmp_path, monkeypatch):
    ledger = flow.document_ledger(spark, str(tmp_path))
    batch = spark.createDataFrame([document(1, "Ames", ANSWER % 4000)], flow.INCOMING)
    run = flow.process_batch(ledger, "m")
    with monkeypatch.context() as m:
        m.setattr(ledger, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            run(batch, 0)
    assert ledger.read("jobs").count() == 0 and ledger.read("requirements").count() == 0
    run(batch, 0)
    assert ledger.read("jobs").count() == 1 and ledger.read("requirements").count() == 2


def test_uploads_are_tried_three_times(spark, tmp_path):
    source, base, check = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "check")
    source.mkdir()
    for name, content in {"a": "1", "b": "22", "c": "333", "d": "4444"}.items():
        (source / f"{name}.txt").write_text(content)
    read = lambda content, attempt: F.when(F.octet_length(content) <= attempt, files.text_of(content))
    flow.take_uploads(flows.file_stream(spark, str(source)), base, check, read)
    ledger = flow.upload_ledger(spark, base)
    name = lambda df, *c: rows(df.withColumn("name", F.regexp_extract("path", "([a-z]+).txt", 1)), "name", *c)
    assert name(flow.upload_states(ledger), "status") == [("a", "processed"), ("b", "retry"), ("c", "retry"), ("d", "retry")]
    assert name(ledger.read("held")) == [("b",), ("c",), ("d",)]
    assert flow.retry_uploads(spark, base, read) == 2 and flow.retry_uploads(spark, base, read) == 0
    settled = [("a", "processed", 1), ("b", "processed", 2), ("c", "processed", 3), ("d", "failed", 3)]
    assert name(flow.upload_states(ledger), "status", "attempts_made") == settled
    assert name(ledger.read("texts"), "text") == [("a", "1"), ("b", "22"), ("c", "333")]
    ledger.compact()
    (source / "e.txt").write_text("1")                          # the stream goes on after the rounds
    flow.take_uploads(flows.file_stream(spark, str(source)), base, check, read)
    assert name(flow.upload_states(ledger), "status", "attempts_made") == [*settled, ("e", "processed", 1)]


def test_compaction_keeps_retry_rounds(spark, tmp_path):
    target = str(tmp_path / "attempts")
    for n in (0, 1):
        spark.createDataFrame([(f"f{n}", 1, False)], "path string, attempt_no int, ok boolean").write.parquet(flows.batch_folder(target, n))
    flows.retry_round(spark, target, 1, lambda df: df.withColumn("ok", F.lit(False)))
    flows.compact_batches(spark, target, lambda df: df, 0)
    every = rows(flows.compacted(spark, target), "path", "attempt_no")
    assert every == [("f0", 1), ("f0", 2), ("f1", 1), ("f1", 2)]


def test_a_written_replacement_character_stays(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("a�b".encode() + b"\xff\xc3" + "ü�".encode())
    assert [r.text for r in files.scan_documents(spark, str(tmp_path)).collect()] == ["a�bü�"]


def test_small_files_come_in_few_batches(spark, tmp_path):
    """By bytes, the number of batches follows the bytes, not the number of files."""
    source, base = tmp_path / "in", str(tmp_path / "t")
    source.mkdir()
    for k in range(230):
        (source / f"{k}.txt").write_text("x" * (k % 4 + 1))
    read = lambda content, attempt: F.when(F.octet_length(content) % 4 < attempt, files.text_of(content))
    flow.take_uploads(flows.file_stream(spark, str(source), bytes_per_batch=400), base, str(tmp_path / "check"), read)
    ledger = flow.upload_ledger(spark, base)
    assert ledger.state()["sources"]["files"] == 1 and ledger.read("attempts").count() == 230
    assert flow.retry_uploads(spark, base, read) == 2
    assert flow.upload_states(ledger).groupBy("status").count().collect() and ledger.read("texts").count() == 230 - 57
