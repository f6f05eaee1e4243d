"""Data-quality rules: every table constraint as a predicate, and the rows that break one.

A rule holds when it is true or unknown, as a table CHECK does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from parcelrules import fixed_values as fv


def _between(column: str, low: float, high: float) -> Column:
    return F.col(column).between(low, high)


PERCENT_COLUMNS = ["max_building_coverage_percent", "max_lot_coverage_percent"]
ACCURACY_COLUMNS = ["overall_accuracy_score", "zone_identification_accuracy", "field_extraction_accuracy",
                    "location_extraction_accuracy"]
REQUIRED = {
    "requirements": ["job_id", "town", "state", "zone"],
    "jobs": ["town", "state"],
    "experiments": ["prompt_name", "prompt_version", "llm_model"],
    "gt_documents": ["document_name", "town", "state"],
    "tests": ["prompt_experiment_id", "ground_truth_doc_id"],
}
UNIQUE = {
    "requirements": ["town", "county", "state", "zone"],
    "jobs": ["town", "county", "state"],
    "experiments": ["prompt_name", "prompt_version"],
    "gt_requirements": ["ground_truth_doc_id", "zone"],
}
# Warn-level bounds: what a rule of this kind plausibly is.
PLAUSIBLE = {
    "interior_min_lot_area_sqft": (5000, 50000),
    "principal_front_yard_ft": (5, 50),
    "principal_side_yard_ft": (5, 50),
    "principal_rear_yard_ft": (5, 50),
    "max_height_feet_total": (25, 100),
    "max_building_coverage_percent": (20, 80),
    "max_lot_coverage_percent": (20, 80),
}


def rules(table: str, columns: list[str]) -> dict[str, Column]:
    """Rule name -> predicate, for the columns the table has."""
    have = set(columns)
    out = {f"{c} not null": F.col(c).isNotNull() for c in REQUIRED.get(table, []) if c in have}
    out |= {f"{c} within 0..100": _between(c, 0, 100) for c in PERCENT_COLUMNS if c in have}
    out |= {f"{c} within 0..1": _between(c, 0, 1)
            for c in [*ACCURACY_COLUMNS, "extraction_confidence", "average_accuracy_score"] if c in have}
    if "llm_temperature" in have:
        out["llm_temperature within 0..2"] = _between("llm_temperature", 0, 2)
    if "document_complexity" in have:
        out["document_complexity in set"] = F.col("document_complexity").isin(fv.COMPLEXITIES)
    return out


def plausibility_rules(columns: list[str]) -> dict[str, Column]:
    return {f"{c} within {lo}..{hi}": _between(c, lo, hi) for c, (lo, hi) in PLAUSIBLE.items() if c in set(columns)}


def violations(table: DataFrame, checks: dict[str, Column], key: list[str]) -> DataFrame:
    """One row per broken rule, found in a single pass over the table."""
    fails = {name: ~F.coalesce(ok, F.lit(True)) for name, ok in checks.items()}
    broken = F.array(*[F.when(bad, F.lit(name)) for name, bad in fails.items()])
    # Sound rows, nearly all of them, leave before any array is built.
    return (table.where(reduce(lambda a, b: a | b, fails.values()))
            .select(*key, F.explode(F.array_compact(broken)).alias("rule")))


def key_violations(table: DataFrame, keys: list[str]) -> DataFrame:
    """Values of a unique key that several rows have, and how many; a key with a null part is never one."""
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return table.where(whole).groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).where("row_count > 1")


def length_rules(limits: dict[str, int]) -> dict[str, Column]:
    """Rule name -> predicate, for texts with a declared length."""
    return {f"{c} within {n} characters": F.length(c) <= n for c, n in limits.items()}


def passing(table: DataFrame, checks: dict[str, Column]) -> DataFrame:
    for ok in checks.values():
        table = table.where(F.coalesce(ok, F.lit(True)))
    return table
