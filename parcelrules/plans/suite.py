"""All named queries; importing a suite module registers its queries."""

from __future__ import annotations

from parcelrules.plans import suite_reports, suite_responses, suite_tables, suite_files, suite_parts, suite_sql  # noqa: F401
from parcelrules.plans.registry import CHECK_SQL, QUERIES

__all__ = ["CHECK_SQL", "QUERIES"]
