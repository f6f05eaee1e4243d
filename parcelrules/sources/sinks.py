"""Writing results: CSV with header, JSON lines, Parquet snapshots, export catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def write_csv(df: DataFrame, folder: str) -> None:
    """Quoted where needed; an empty result still has its header."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(folder)


def read_csv(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True)
            .csv(folder))


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(folder)


def read_json(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(folder)


def write_snapshot(df: DataFrame, folder: str, partition_by: list[str] | None = None) -> None:
    """A whole table as Parquet; facts are partitioned by day so that a period is pruned to its folders."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(folder)


def read_snapshot(spark: SparkSession, folder: str, schema: StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(folder)


# Exports and what they hold; the fields come from the plans themselves.
EXPORTS = {
    "prompt_performance": "experiments with test counts, mean accuracies and success rate",
    "test_results_export": "tests of a period with prompt, document, bands and delta to the baseline",
    "accuracy_trends": "daily means per prompt and model with trend and rating",
    "field_accuracy_heatmap": "relative accuracy of five fields per zone result",
    "zone_extraction_analysis": "difficulty of each verified zone",
    "accuracy_timeline": "daily accuracy per prompt against the baseline",
    "requirements_export": "current requirements",
    "jobs_export": "jobs with status and times",
}


def catalogue(spark: SparkSession, reports: dict[str, DataFrame]) -> DataFrame:
    """One row per export field, read from the reports' schemas without running them."""
    rows = [(name, EXPORTS.get(name, ""), i, f.name, f.dataType.simpleString())
            for name, df in reports.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "export string, description string, position int, field string, type string")
