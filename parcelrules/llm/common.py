"""What the operators of this folder share: table access, Arrow columns as byte arrays, word hashes.

The Python operators work on whole Arrow batches with numpy. A batch's texts
lie in one byte array; words are half-open byte ranges into it, and a word's
identity is a 64-bit hash (two different words of a corpus with a hundred
million distinct words meet with a chance below one in a thousand).
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelrules.session import prepare, remove_folders, work_folder

BATCH_ROWS = 1000        # rows handed to Python at once, ...
BATCH_BYTES = 1 << 22    # ... and about their bytes, but one row at least
BROADCAST_ROWS = 1 << 18 # a side of short rows (64 bytes at most) is broadcast up to this many rows, 16 MB
BLOCK_BYTES = 1 << 19    # bytes hashed at once; bounds the temporary arrays and the tables of powers
LONG_WORD = 1 << 18      # bytes; a longer word's hash is a digest


def session(spark: SparkSession) -> SparkSession:
    """The library's settings, and smaller Arrow batches, as texts are long."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{folder}/{name}.parquet")


def materialised(df: DataFrame, purpose: str, small: bool = False, narrow: bool = False) -> DataFrame:
    """``df`` written as Parquet to the folder all executors share, and read from there.

    ``small``: as one file. ``narrow``: rows of a few numbers, as two files per core of the cluster at most.
    """
    path = work_folder(df.sparkSession, purpose)
    files = 1 if small else 2 * df.sparkSession.sparkContext.defaultParallelism if narrow else None
    (df.coalesce(files) if files else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder, dealt to as many buckets by ``key`` as a shuffle has partitions; joins on ``key`` need no shuffle of it."""
    spark, path = df.sparkSession, work_folder(df.sparkSession, purpose)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


def removed(table: DataFrame) -> None:
    """Delete a table that ``materialised`` wrote, once nothing reads it any more."""
    remove_folders(table.sparkSession, {f.rsplit("/", 1)[0] for f in table.inputFiles()})


OWN = ("doc_id", "text", "lang", "source", "n_chars")


def shielding(operator):
    """For operators that return their input's columns: extra columns can't clash with their working columns."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        names = [n if n in OWN else f"_extra_{i}" for i, n in enumerate(docs.columns)]
        out = operator(docs.toDF(*names), *args, **options)
        return out.select(*names).toDF(*docs.columns)

    return run


def slim(side: DataFrame, rows: int) -> DataFrame:
    """A side of short rows: broadcast when its counted size is small, else left to a shuffled join."""
    return F.broadcast(side) if rows <= BROADCAST_ROWS else side


# --- Arrow columns as numpy --------------------------------------------------------

def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text or binary column as one byte array and the offsets of its rows; nulls are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, one row at least."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        to = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        to = min(max(to, row + 1), rows)
        yield row, to
        row = to


ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

SPACE = np.zeros(256, bool)          # the separators of words [^\x20\x09-\x0D]+
SPACE[[0x20, *range(0x09, 0x0E)]] = True

NO_WORD = np.zeros(256, bool)        # the separators of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
NO_WORD[0x00:0x30] = True
NO_WORD[0x3A:0x61] = True
NO_WORD[0x7B:0x80] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each row's first word (one entry more than rows)."""
    inside = ~separator[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_random = np.random.default_rng(20240229)
BYTE_VALUE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64, for i < n at least."""
    if len(_powers["up"]) < n:
        size = 1 << math.ceil(math.log2(n))
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[name] = np.multiply.accumulate(row)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; ranges in order of their starts."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    for long in [*np.flatnonzero(ends - starts > LONG_WORD).tolist(), len(starts)]:
        while at < long:
            to = min(max(int(np.searchsorted(ends, starts[at] + BLOCK_BYTES, "right")), at + 1), long)
            low, high = int(starts[at]), int(ends[to - 1])
            up, down = powers(high - low + 1)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(BYTE_VALUE[data[low:high]] * up[:high - low], out=sums[1:])
            s, e = starts[at:to] - low, ends[at:to] - low
            out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
            at = to
        if at < len(starts):
            digest = hashlib.blake2b(data[starts[at]:ends[at]].data, digest_size=8).digest()
            out[at] = np.frombuffer(digest, np.uint64)[0]
            at += 1
    return out


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of every run of ``k`` words; run i starts at word i."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = mix(h * BASE + words[i:i + n])
    return h
