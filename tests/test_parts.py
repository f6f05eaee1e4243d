"""Tables in parts: what a change touches, old versions, daily partials with late tests, ids in bitmaps."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parcelrules.operators import daily, stats
from parcelrules.plans import reports
from parcelrules.sources.parted import PartedTable, bucketed_by, upsert

T0 = datetime(2024, 1, 1)


def files(folder):
    return {str(p): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def opened(df):
    """The folders of parts a frame reads."""
    return {f.rsplit("/", 2)[1] for f in df.inputFiles()}


REQ = "id int, town string, county string, state string, zone string, v int, created_at timestamp, updated_at timestamp"


def requirement(i, zone, v, county="C"):
    return (i, "T", county, "NJ", zone, v, T0, T0)


def test_an_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    table = PartedTable(spark, str(tmp_path), REQ, bucketed_by(["town", "county", "state", "zone"], 8))
    old = [requirement(i, f"Z{i}", i) for i in range(60)] + [requirement(60, "N", 1, None), requirement(61, "N", 1, None)]
    assert table.read().count() == 0 and table.append(spark.createDataFrame(old, REQ), "load", 0)
    before, now = files(tmp_path), F.lit(T0 + timedelta(days=9))
    changes = spark.createDataFrame([requirement(100, "Z7", 70), requirement(101, "Z7", 71), requirement(102, "N", 2, None)], REQ)
    touched = table.touched(changes)
    assert upsert(table, changes, now, "changes", 0) and 0 < len(touched) < 8
    after = files(tmp_path)
    assert before.items() <= after.items()                       # nothing old was written to
    assert {p.split("part=")[1].split("/")[0] for p in after.keys() - before.keys()} == touched
    got = {r.id: (r.v, r.updated_at) for r in table.read().collect()}
    assert len(got) == 63 and 7 not in got and 100 not in got    # keys with a null are never equal
    assert got[101] == (71, T0 + timedelta(days=9)) and got[8] == (8, T0) and got[102] == (2, T0)
    # Sent again: nothing changes. Version 1 is as it was, until vacuum.
    assert not upsert(table, changes, now, "changes", 0) and files(tmp_path) == after
    assert {r.id for r in table.read(version=1).collect()} == set(range(62))
    assert table.vacuum() == len(touched) and {r.id for r in table.read().collect()} == set(got)


def test_a_part_without_rows_goes_and_a_commit_cut_short_shows_nothing(spark, tmp_path):
    table = PartedTable(spark, str(tmp_path), "k string, x int", F.col("k"))
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, x int")
    table.append(rows, "s", 0)
    assert table.touched(rows) == {"a", "b", "none"} and opened(table.read(["b", "gone"])) == {"part=b"}
    table._write(rows)                                           # no manifest follows
    assert sorted(r.x for r in table.read().collect()) == [1, 2, 3]
    table.replace(rows.where("k = 'a'").withColumn("x", F.lit(9)), ["a", "b"], "s", 1)
    assert sorted(r.x for r in table.read().collect()) == [3, 9] and table.newer(1) == ["a"]
    with pytest.raises(ValueError):
        table.replace(rows, ["a"], "s", 2)
    assert sorted(r.x for r in table.read().collect()) == [3, 9]
    table.append(rows.where("false"), "s", 2)
    assert table.read().count() == 2


TEST = "prompt_experiment_id long, ground_truth_doc_id long, test_date timestamp_ntz, extraction_success boolean, " \
       "overall_accuracy_score double, zone_identification_accuracy double, field_extraction_accuracy double, " \
       "processing_time_seconds double, llm_tokens_used long"
EXPERIMENTS = "id long, prompt_name string, prompt_version string, llm_model string, is_baseline boolean, created_at timestamp_ntz"


def made(n, days, start=0):
    return [((i * 7) % 5, i * 40_000 - 200_000, None if i % 17 == 5 else T0 + timedelta(days=i % days, hours=i % 24), i % 3 > 0,
             None if i % 11 == 0 else (i * 37 % 100) / 100, (i * 13 % 100) / 100, (i * 3 % 100) / 100, float(i), i) for i in range(start, start + n)]


@pytest.fixture()
def experiments(spark):
    return spark.createDataFrame([(i, f"p{i % 2}", str(i), "m", i == 0, T0) for i in range(6)], EXPERIMENTS)


def plain(df):
    return sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()], key=str)


def test_a_late_test_changes_one_day(spark, tmp_path, experiments):
    first, late = made(90, 9), [(2, 5, T0 + timedelta(days=4, hours=3), True, 0.25, 0.5, 0.5, 1.0, 10)]
    tests = spark.createDataFrame(first, TEST)
    held = daily.DailyTests(spark, str(tmp_path), tests.schema)
    assert held.refresh() == []                                  # nothing there yet
    held.add(tests, "tests", 0)
    assert len(held.refresh()) == 10 and held.refresh() == []    # nine days and the undated
    before = files(tmp_path / "sums")
    held.add(spark.createDataFrame(late, TEST), "tests", 1)
    assert not held.add(spark.createDataFrame(late, TEST), "tests", 1)
    assert held.refresh() == ["2024-01-05"]
    after = files(tmp_path / "sums")
    assert before.items() <= after.items() and all("part=2024-01-05" in p for p in after.keys() - before.keys())
    both = spark.createDataFrame(first + late, TEST)
    for make in (reports.accuracy_trends, reports.accuracy_timeline):
        assert plain(make(None, experiments, "2024-01-08", 5, partials=held.partials())) == plain(make(both, experiments, "2024-01-08", 5))
    # Only the folders of the days asked for are opened.
    days = held.partials(date(2024, 1, 3), date(2024, 1, 4))
    assert opened(days) == {"part=2024-01-03", "part=2024-01-04"} and {r.day.day for r in days.collect()} == {3, 4}


@pytest.mark.parametrize("period", ["day", "month"])
def test_summary_and_distinct_ids_of_any_days(spark, tmp_path, experiments, period):
    rows = made(200, 50) + made(40, 3)                           # ids repeat on other days, some are negative
    tests = spark.createDataFrame(rows + [(None, None, T0, True, .5, .5, .5, 1.0, 1)], TEST)
    held = daily.DailyTests(spark, str(tmp_path), tests.schema, period)
    held.add(tests, "tests", 0)
    held.refresh()
    for start, end in ((date(2024, 1, 2), date(2024, 2, 3)), (date(2024, 1, 31), date(2024, 1, 31)), (date(2030, 1, 1), date(2030, 1, 2))):
        inside = [r for r in rows if r[2] and start <= r[2].date() <= end]
        for kind, column in (("experiment", 0), ("document", 1)):
            assert held.distinct_ids(kind, start, end).first().n == len({r[column] for r in inside})
        got = daily.test_summary(experiments, held, start, end)
        want = stats.test_summary(experiments, tests, datetime.combine(start, datetime.min.time()),
                                  datetime.combine(end, datetime.max.time()))
        assert plain(got.drop("total_documents")) == plain(want) and got.first().total_documents == len({r[1] for r in inside})
    assert held.distinct_ids("document").first().n == len({r[1] for r in rows})
