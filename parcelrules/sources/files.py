"""Document files: listing, admission and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parcelrules import fixed_values as fv
from parcelrules.functions.text import file_name, file_suffix, human_size

REPLACEMENT = "�"
WRITTEN = "\x00\ufffe<replacement character>\ufffe\x00"      # stands for one while undecodable bytes are dropped


def files_of(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """path, modificationTime, length and content; content is read only if selected."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob)
            .option("recursiveFileLookup", str(recursive).lower()).load(folder))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files with size and type, newest first; no file is opened."""
    files = files_of(spark, folder).select("path", "modificationTime", "length")
    suffix = file_suffix(F.col("path"))
    return files.select(
        file_name(F.col("path")).alias("name"), F.col("length").alias("size"),
        human_size(F.col("length").cast("double")).alias("size_human"),
        F.date_format("modificationTime", "yyyy-MM-dd HH:mm:ss").alias("modified"),
        F.when(suffix == "", F.lit("unknown")).otherwise(suffix).alias("type"),
    ).orderBy(F.desc("modified"), "name")


def admission(files: DataFrame, suffixes: list[str] = fv.ALLOWED_SUFFIXES,
              max_bytes: int = fv.MAX_FILE_BYTES) -> DataFrame:
    """Add ``reject_reason`` from path and length alone; null when admitted."""
    return files.withColumn("reject_reason", F.when(~file_suffix(F.col("path")).isin(suffixes), F.lit("suffix"))
                            .when(F.col("length") > max_bytes, F.lit("size")))


def text_of(content: Column) -> Column:
    """Bytes as UTF-8 text; what can't be decoded is dropped, a replacement character that was written stays."""
    raw = F.replace(content.cast("string"), F.lit(REPLACEMENT), F.lit(WRITTEN))
    return F.replace(F.replace(F.make_valid_utf8(raw), F.lit(REPLACEMENT), F.lit("")), F.lit(WRITTEN), F.lit(REPLACEMENT))


def as_text(files: DataFrame) -> DataFrame:
    """Add suffix, text (UTF-8, undecodable bytes dropped) and ``needs_parser`` for PDF and Word."""
    suffix = file_suffix(F.col("path"))
    needs = suffix.isin(fv.PARSER_SUFFIXES)
    return files.select(
        "path", suffix.alias("suffix"), "length", needs.alias("needs_parser"),
        F.when(~needs, text_of(F.col("content"))).alias("text"))


def suffix_glob(suffixes: list[str]) -> str:
    """A file name pattern for the suffixes in either case, which keeps other files from being opened."""
    return "*.{" + ",".join("".join(f"[{x.lower()}{x.upper()}]" if x.isalpha() else x for x in s) for s in suffixes) + "}"


def admitted(files: DataFrame) -> DataFrame:
    """Admitted files; the length is a filter of its own, as only that reaches the source."""
    return admission(files.where(F.col("length") <= fv.MAX_FILE_BYTES)).where(F.col("reject_reason").isNull())


def scan_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Admitted files of a folder as text; suffix and size are looked at before a file is read."""
    return as_text(admitted(files_of(spark, folder, suffix_glob(fv.ALLOWED_SUFFIXES))))


def rejected(files: DataFrame) -> DataFrame:
    """path, length and reason of the files that are not admitted; no content is read."""
    return admission(files.select("path", "modificationTime", "length")).where(F.col("reject_reason").isNotNull())


def rejected_documents(spark: SparkSession, folder: str) -> DataFrame:
    return rejected(files_of(spark, folder))


def write_text_files(documents: DataFrame, folder: str, group: list[str], per_file: int = 200) -> None:
    """Texts to ``.txt`` files, foldered by ``group``, at most ``per_file`` texts in each.

    A salt spreads a large group over many tasks.
    """
    salt = (F.col("doc_id") / (per_file * 20)).cast("bigint")
    (documents.repartition(*group, salt).select(*group, "text").write.partitionBy(*group)
     .option("maxRecordsPerFile", per_file).text(folder))
