"""Listings: optional filters, point look-ups and paging in a total order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parcelrules.operators.skew import splittable
from parcelrules.operators.stats import last_days


def _containing(df: DataFrame, filters: dict[str, str | None]) -> DataFrame:
    for column, part in filters.items():
        if part:
            df = df.where(F.col(column).ilike(f"%{part}%"))
    return df


def _equal(df: DataFrame, filters: dict[str, object]) -> DataFrame:
    for column, value in filters.items():
        if value:
            df = df.where(F.col(column) == value)
    return df


MOST_OFFSET = 10_000      # a page further on is asked for by the key of the row before it


def _page(df: DataFrame, limit: int, offset: int) -> DataFrame:
    """Each task keeps offset + limit rows, so the offset is bounded; see :func:`after`."""
    if offset > MOST_OFFSET:
        raise ValueError(f"offset must be at most {MOST_OFFSET}; ask for the rows after the last key")
    return df.offset(offset).limit(limit) if offset else df.limit(limit)


def after(df: DataFrame, key: dict[str, object], descending: tuple[str, ...] = ()) -> DataFrame:
    """The rows that follow ``key`` in the order of its columns; with a limit, the next page of any depth.

    Columns ascend with nulls first; those named in ``descending`` descend with nulls last.
    """
    follows, equal = F.lit(False), F.lit(True)
    for column, value in key.items():
        own, v = F.col(column), F.lit(value)
        if column in descending:
            further = F.lit(False) if value is None else own.isNull() | (own < v)
        else:
            further = own.isNotNull() if value is None else F.coalesce(own > v, F.lit(False))
        follows, equal = follows | (equal & further), equal & own.eqNullSafe(v)
    return df.where(follows)


NEWEST = ("created_at",)


def search_requirements(requirements: DataFrame, town: str | None = None, county: str | None = None,
                        state: str | None = None, zone: str | None = None,
                        limit: int = 100, offset: int = 0) -> DataFrame:
    """``%`` and ``_`` in a search text act as wild cards."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1..500 and offset not negative")
    df = _equal(_containing(requirements, {"town": town, "county": county, "zone": zone}), {"state": state})
    return _page(df.orderBy("town", "zone", "id"), limit, offset)


def requirements_by_location(requirements: DataFrame, town: str, state: str,
                             county: str | None = None) -> DataFrame:
    return _equal(requirements, {"town": town, "state": state, "county": county}).orderBy("zone", "id")


def search_jobs(jobs: DataFrame, status: str | None = None, town: str | None = None, state: str | None = None,
                limit: int = 100, offset: int = 0, last: dict[str, object] | None = None) -> DataFrame:
    """``last``: created_at and id of the row before the page, in this order."""
    df = _equal(_containing(jobs, {"town": town}), {"processing_status": status, "state": state})
    df = after(df, last, NEWEST) if last else df
    return _page(df.orderBy(F.desc("created_at"), "id"), limit, offset)


def list_documents(documents: DataFrame, status: str | None = None, municipality: str | None = None,
                   skip: int = 0, limit: int = 100, last: dict[str, object] | None = None) -> DataFrame:
    """A page of documents; ``total`` counts all documents that pass the filters. ``last``: as in :func:`search_jobs`."""
    df = _equal(_containing(documents, {"municipality": municipality}), {"processing_status": status})
    total = df.agg(F.count(F.lit(1))).scalar()
    df = after(df, last, NEWEST) if last else df
    return _page(df.orderBy(F.desc("created_at"), "id"), limit, skip).withColumn("total", total)


def by_id(table: DataFrame, row_id: object) -> DataFrame:
    return table.where(F.col("id") == row_id)


def by_ids(table: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose ``key`` is among the wanted ids (a DataFrame with that column)."""
    # Spread anew, so that the rows of a hot key can be split over tasks.
    return table.join(splittable(wanted.select(key).distinct(), key), key, "left_semi").select(*table.columns)


def active_experiments(stats: DataFrame, active_only: bool = True) -> DataFrame:
    rows = stats.where("is_active") if active_only else stats
    return rows.orderBy(F.desc_nulls_first("average_accuracy_score"), "id")


def tests_last_n_days(tests: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return tests.where(last_days("test_date", as_of, days)).where(
        F.col("test_date") <= F.lit(as_of).cast("timestamp_ntz"))


def gt_requirements_for_doc(gt_requirements: DataFrame, doc_id: object) -> DataFrame:
    return gt_requirements.where(F.col("ground_truth_doc_id") == doc_id).orderBy("zone")


def gt_requirements_for_docs(gt_requirements: DataFrame, gt_documents: DataFrame) -> DataFrame:
    """Verified zones of all the given documents, with the document's name."""
    docs = gt_documents.select(F.col("id").alias("ground_truth_doc_id"), "document_name")
    return gt_requirements.join(docs, "ground_truth_doc_id")
