"""Appending only rows that keep every rule of a table; the rest come back with the rules they break.

Plain Parquet knows no constraints. Here a batch is judged before it is appended: predicates,
references to other tables and a unique key. A row that breaks a predicate or a reference takes no key,
so that a sound row of the same key still gets in. Of several sound rows with one key the first of
``order`` is taken, which must tell rows apart. A key with a null part conflicts with nothing, and a null
reference is sound unless a predicate forbids it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from parcelrules.operators.maintenance import append_rows
from parcelrules.operators.skew import splittable

TAKEN = "key taken"
TWICE = "key twice"


def unknown(column: str) -> str:
    return f"{column} unknown"


def judged(old: DataFrame, new: DataFrame, checks: dict[str, Column], parents: dict[str, DataFrame],
           key: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """``new`` with ``reasons``, the names of the rules a row breaks; none for a row that may be appended.

    ``parents``: column -> the table whose ``id`` it must be found in. Predicates are as in
    :mod:`quality`: true or unknown holds. Only keys and ids of the other tables are shuffled.
    """
    rows = new.withColumn("reasons", F.array_compact(F.array(
        *[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in checks.items()])).cast("array<string>"))
    for column, parent in parents.items():
        known = parent.where("id IS NOT NULL").select(F.col("id").alias("_id")).distinct()
        missing = F.col(column).isNotNull() & F.col("_id").isNull()
        rows = rows.join(splittable(known, "_id"), F.col(column) == F.col("_id"), "left").withColumn(
            "reasons", F.when(missing, F.array_append("reasons", F.lit(unknown(column)))).otherwise(F.col("reasons"))).drop("_id")
    if not key:
        return rows
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    place = F.struct(*order)
    # One row per key: whether the table has it, and the first sound row of the batch.
    sound = rows.where(whole & (F.size("reasons") == 0)).select(*key, F.lit(False).alias("_old"), place.alias("_place"))
    held = old.where(whole).select(*key, F.lit(True).alias("_old"), F.lit(None).cast(sound.schema["_place"].dataType).alias("_place"))
    per_key = held.unionByName(sound).groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(
        F.max("_old").alias("_taken"), F.min("_place").alias("_first"))
    met = rows.join(splittable(per_key, *[f"_{k}" for k in key]), reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in key]), "left")
    clash = F.when(F.col("_taken"), F.lit(TAKEN)).when((F.size("reasons") == 0) & (place != F.col("_first")), F.lit(TWICE))
    return met.withColumn("reasons", F.when(clash.isNotNull(), F.array_append("reasons", clash)).otherwise(F.col("reasons"))).select(
        *new.columns, "reasons")


def append(old: DataFrame, judged_rows: DataFrame, defaults: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """``old`` with the sound rows, and the others with their ``reasons``."""
    good = judged_rows.where(F.size("reasons") == 0).drop("reasons")
    return append_rows(old, good, defaults or {}), judged_rows.where(F.size("reasons") > 0)


def truth_rows(old: DataFrame, new: DataFrame, documents: DataFrame) -> DataFrame:
    """Verified requirements judged: a zone of a known document, no value below zero, one row per document and zone."""
    values = [n for n, t in new.dtypes if t == "double"]
    checks = {"ground_truth_doc_id not null": F.col("ground_truth_doc_id").isNotNull(), "zone not null": F.col("zone").isNotNull()}
    checks |= {f"{v} not negative": F.col(v) >= 0 for v in values}
    return judged(old, new, checks, {"ground_truth_doc_id": documents}, ["ground_truth_doc_id", "zone"], ["id"])
