"""Counts and bounds of stored tables from Parquet footers alone.

Spark's newer Parquet reader takes ungrouped counts, minima and maxima from the footers' statistics, so
that no column is read: the work is one footer per file, whatever the rows. It does so for numbers and
dates without a filter; for texts and timestamps footers hold no exact bounds, but their filled rows are
counted. Only tables opened here use that reader.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

V1_SOURCES = "spark.sql.sources.useV1SourceList"


def opened(spark: SparkSession, folder: str) -> DataFrame:
    """A Parquet table whose whole-table aggregates come from the footers."""
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    before = spark.conf.get(V1_SOURCES)
    spark.conf.set(V1_SOURCES, ",".join(s for s in before.split(",") if s.strip() != "parquet"))
    try:
        return spark.read.parquet(folder)
    finally:
        spark.conf.set(V1_SOURCES, before)


def zero_if_none(count: str) -> Column:
    """Counts from footers are summed, and the sum over files without rows is null, though Spark takes a count for never null."""
    return F.coalesce(F.nullif(F.col(count), F.lit(-1)), F.lit(0)).alias(count)


def footer_counts(spark: SparkSession, tables: dict[str, tuple[str, str, str]]) -> DataFrame:
    """One row per table of ``tables`` (name -> folder, key, other column): rows, bounds of the key, rows with the column filled.

    An empty table has no rows and null bounds.
    """
    parts = [opened(spark, folder).agg(F.count(F.lit(1)).alias("row_count"), F.min(key).alias("least_id"), F.max(key).alias("greatest_id"),
                                       F.count(other).alias("filled_rows"))
             .select(F.lit(name).alias("table_name"), zero_if_none("row_count"), F.col("least_id").cast("long").alias("least_id"),
                     F.col("greatest_id").cast("long").alias("greatest_id"), zero_if_none("filled_rows"))
             for name, (folder, key, other) in tables.items()]
    return reduce(DataFrame.unionByName, parts)
