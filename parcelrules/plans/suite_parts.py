"""Tables in parts as named queries: reports from daily partials, upserts that rewrite buckets."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from parcelrules.operators import daily
from parcelrules.operators.maintenance import UPSERT_KEY
from parcelrules.plans import reports
from parcelrules.plans.registry import CHECK_SQL, Tables, query, rounded
from parcelrules.plans.suite_reports import AS_OF
from parcelrules.plans.suite_tables import NOW
from parcelrules.session import work_folder
from parcelrules.sources.parted import PartedTable, bucketed_by, upsert

FACTS = ["prompt_experiment_id", "ground_truth_doc_id", "test_date", "extraction_success", *reports.DAILY_SUMS]
BUCKETS = 16


def held_tests(t: Tables) -> daily.DailyTests:
    """All tests, those of the later epochs in a second batch after the partials were made once; by month, since the given days are small."""
    rows = t.tests.select(*FACTS, "test_epoch")
    held = daily.DailyTests(t.spark, work_folder(t.spark, "daily"), t.tests.select(*FACTS).schema, period="month")
    for batch, part in enumerate((rows.where("test_epoch <= 4"), rows.where("test_epoch > 4"))):
        held.add(part.drop("test_epoch"), "tests", batch)
        held.refresh()
    return held


@query("daily_trends", CHECK_SQL["accuracy_trends"])
def daily_trends(t):
    return rounded(reports.accuracy_trends(None, t.experiments, AS_OF, partials=held_tests(t).partials()))


@query("daily_timeline", CHECK_SQL["accuracy_timeline"])
def daily_timeline(t):
    return rounded(reports.accuracy_timeline(None, t.experiments, AS_OF, partials=held_tests(t).partials()))


@query("daily_summary", f"""SELECT s.*, (SELECT count(DISTINCT l_orderkey) FROM lineitem
    WHERE l_shipdate BETWEEN TIMESTAMP '2001-08-01' AND TIMESTAMP '2001-11-05') AS total_documents
    FROM ({CHECK_SQL["test_summary"]}) s""")
def daily_summary(t):
    return rounded(daily.test_summary(t.experiments, held_tests(t), date(2001, 8, 1), date(2001, 11, 5)))


def upserted(t: Tables) -> PartedTable:
    """The requirements in key buckets as version 1, with the changes as version 2."""
    old, changes = (rows.withColumn("updated_at", F.col("created_at")) for rows in (t.requirements, t.requirement_changes))
    table = PartedTable(t.spark, work_folder(t.spark, "requirements"), old.schema, bucketed_by(UPSERT_KEY, BUCKETS))
    table.append(old, "load", 0)
    upsert(table, changes, F.expr(NOW), "changes", 0)
    return table


@query("versioned_upsert", CHECK_SQL["upsert_touching"])
def versioned_upsert(t) -> DataFrame:
    return rounded(upserted(t).read())


@query("versioned_before", "SELECT *, created_at AS updated_at FROM requirements", ("requirements",))
def versioned_before(t) -> DataFrame:
    return upserted(t).read(version=1)
