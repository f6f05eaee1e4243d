"""The corpus pipeline: documents in, packed training windows out.

Each stage works on all rows that the one before kept; ``run`` writes a stage's
rows and reads them again. All stages but the last return the columns of
``documents``: rows with nulls, empty texts or repeated ids go through as each
operator's module defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelrules.llm import common as c, decontaminate, divergence, order_minhash, packing, secret_cnn
from parcelrules.llm.suite import tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the plain rules, or lie too far from their language's reference, go."""
    return divergence.keep_good(prepared(spark, docs))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates the document with the least doc_id stays."""
    return order_minhash.one_of_each(prepared(spark, docs))


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word inside a benchmark window go."""
    return decontaminate.remove_contaminated(prepared(spark, docs), c.table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secret_cnn.redact(prepared(spark, docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of windows of 4096 ids, with the ids and their checksum."""
    return packing.pack(prepared(spark, docs), tokenizer_path()).withColumn("ids_crc32", F.crc32("ids"))


def prepared(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The same rows under the library's session settings."""
    c.session(spark)
    return docs


STAGES = [
    ("quality rules", good_quality),
    ("near-duplicates", one_of_each_class),
    ("benchmark decontamination", clean_of_benchmark),
    ("secret scans", without_secrets),
    ("packing", packed),
]

# Packing follows a tokenizer's ids, which SQL can't express; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = c.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = c.materialised(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
