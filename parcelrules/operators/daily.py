"""Reports from stored daily partials instead of all tests.

Tests are kept by period (a day, or a month where days are small). ``refresh`` recomputes the
partials of those periods only to which tests were added since it last ran: sums and counts per day and
experiment, and bitmaps of the ids tested. Means over any days follow from the sums. Distinct counts don't
add up, but bitmaps do: the ids of several days are the union of their bits, exact for any 64-bit id.
A bitmap row covers 32,768 ids, so a day's rows grow with the span of its ids, not with its tests.

Adding a batch again, or refreshing again, changes nothing; a run cut short is simply repeated.
Tests without a date are a period of their own.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from parcelrules.operators import stats
from parcelrules.plans import reports
from parcelrules.sources.parted import PartedTable

PERIODS = {"day": "yyyy-MM-dd", "month": "yyyy-MM"}
SUMS = "day date, id bigint, tests bigint, ok bigint, " + ", ".join(
    [f"s_{c} double" for c in reports.DAILY_SUMS] + [f"n_{c} bigint" for c in reports.DAILY_SUMS])
BITS = "day date, kind string, bucket bigint, bits binary"
KINDS = {"experiment": "prompt_experiment_id", "document": "ground_truth_doc_id"}


def id_bits(tests: DataFrame) -> DataFrame:
    """Per day and kind of id, bitmaps of the ids that occur."""
    ids = tests.select(F.to_date("test_date").alias("day"), F.explode(F.create_map(
        *[x for kind, c in KINDS.items() for x in (F.lit(kind), F.col(c).cast("long"))])).alias("kind", "id")).where("id IS NOT NULL")
    return ids.groupBy("day", "kind", F.bitmap_bucket_number("id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))


class DailyTests:
    """Tests and their partials under ``base``; ``tests`` is their schema."""

    def __init__(self, spark: SparkSession, base: str, tests: StructType, period: str = "day"):
        def part(column: str):
            return F.date_format(column, PERIODS[period])

        self.format = PERIODS[period]
        self.tests = PartedTable(spark, f"{base}/tests", tests, part("test_date"))
        self.sums = PartedTable(spark, f"{base}/sums", SUMS, part("day"))
        self.bits = PartedTable(spark, f"{base}/bits", BITS, part("day"))

    def add(self, rows: DataFrame, source: str, batch: int) -> bool:
        return self.tests.append(rows, source, batch)

    def refresh(self) -> list[str]:
        """Bring the partials up to date; the periods recomputed for the sums."""
        version, changed = self.tests.state()["version"], []
        for table, make in ((self.bits, id_bits), (self.sums, reports.daily_partials)):
            changed = self.tests.newer(table.state()["sources"].get("tests", 0))
            if changed:
                table.replace(make(self.tests.read(changed)), changed, "tests", version)
        return changed

    def _between(self, table: PartedTable, start: date | None, end: date | None) -> DataFrame:
        """The partials of the days asked for; folders of other periods aren't opened."""
        first, last = (x.strftime("%Y-%m-%d")[:len(self.format)] if x else None for x in (start, end))
        parts = [p for p in table.state()["parts"] if (first is None or p >= first) and (last is None or p <= last)]
        rows = table.read(parts)
        rows = rows.where(F.col("day") >= F.lit(start)) if start else rows
        return rows.where(F.col("day") <= F.lit(end)) if end else rows

    def partials(self, start: date | None = None, end: date | None = None) -> DataFrame:
        """Sums per day and experiment, for the reports' ``partials``."""
        return self._between(self.sums, start, end)

    def distinct_ids(self, kind: str, start: date | None = None, end: date | None = None) -> DataFrame:
        """One row, ``n``: how many different ids of a kind were tested in the days given."""
        rows = self._between(self.bits, start, end).where(F.col("kind") == kind)
        merged = rows.groupBy("bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
        return merged.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def test_summary(experiments: DataFrame, held: DailyTests, start: date, end: date) -> DataFrame:
    """As :func:`stats.test_summary` for the days from ``start`` to ``end``, without reading a test, and ``total_documents``, the documents tested."""
    score = reports.DAILY_SUMS[0]
    inside = F.col("day").between(F.lit(start), F.lit(end)) | F.col("day").isNull()
    per_exp = held.partials().groupBy("id").agg(
        F.sum("tests").alias("n"), F.try_divide(F.sum(f"s_{score}"), F.sum(f"n_{score}")).alias("mean"),
        F.coalesce(F.sum(F.when(inside, F.col("tests"))), F.lit(0)).alias("n_in"),
        F.coalesce(F.sum(F.when(inside, F.col(f"n_{score}"))), F.lit(0)).alias("k_in"),
        F.sum(F.when(inside, F.col(f"s_{score}"))).alias("sum_in"))
    return stats.summary_of(experiments, per_exp).withColumn("total_documents", held.distinct_ids("document", start, end).scalar())
