"""Exact k-means over whole-number vectors, with a filter in rotated coordinates.

The components become floor(256 * x). A principal-component rotation of all kept
vectors is found from their summed products; of each vector the ``LEAD`` leading
rotated coordinates and the norm of the rest are stored beside its integers. For a
vector x and a centroid c, the squared distance of the leading coordinates plus the
squared difference of the two residual norms never exceeds the squared distance
of x and c (the triangle inequality in the remaining coordinates). So the centroid of the
least bound is measured first, in integers; a centroid whose bound lies above that
distance is out, and each survivor is measured in integers too. Floating point
only decides what is measured, with a margin for its rounding.

Each round is one pass over the stored table. Tasks hold counts and sums for their rows,
grouped sums follow, and only the ``k`` centroids (k * 64 numbers) pass through the
driver. Sums are whole numbers, so the order of rows does not show.

Defined cases: vectors that are null, of another length or with a component that is null or
not finite take no part; extra columns are not read. A null vec_id is kept, and as a
first centroid it comes after all others. Rows with one vec_id are rows of their own;
among them the order of first centroids follows the components. With fewer vectors than ``k``
there are as many centroids as vectors; an empty table gives no rows. Components of
2 ** 27 and more (after scaling) can't give distances that fit a long and end the job with an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parcelrules.llm import common as c, vectors

SIZE = 64
LEAD = 16
CLUSTERS = 40
ROUNDS = 5
LARGEST = 1 << 27
MARGIN = 1e-9                     # of the squared norms: far above the rounding of 64 products
STORED = "vec_id long, q binary, lead binary, rest double"
RESULT = "vec_id long, cluster int, distance long"


def kept(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """vec_ids and whole components of the rows that take part."""
    flat, offsets, sound = vectors.whole_components(batch.column("embedding"))
    rows = np.flatnonzero(sound & (np.diff(offsets) == SIZE))
    q = vectors.pick(flat, offsets, rows, SIZE)
    if len(q) and np.abs(q).max() >= LARGEST:
        raise ValueError(f"a component of {np.abs(q).max():.3g} (times {vectors.SCALE}) is too large for distances in a long")
    return batch.column("vec_id").take(pa.array(rows)), q.astype(np.int64)


def source(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def summed(parts: DataFrame) -> dict[int, int | float]:
    """(slot, value) rows added up; a bounded number of slots."""
    return {r["slot"]: r["value"] for r in parts.groupBy("slot").agg(F.sum("value").alias("value")).collect()}


def rotation(embeddings: DataFrame) -> np.ndarray | None:
    """The principal axes of all kept vectors as rows, leading ones first; None if there are no vectors."""

    def products(batches):
        total = np.zeros((SIZE + 1, SIZE + 1))
        for batch in batches:
            q = kept(batch)[1]
            q = np.hstack([np.ones((len(q), 1)), q])
            total += q.T @ q
        if total[0, 0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["slot", "value"])

    found = summed(source(embeddings).mapInArrow(products, "slot long, value double"))
    if not found:
        return None
    total = np.array([found[i] for i in range((SIZE + 1) ** 2)]).reshape(SIZE + 1, SIZE + 1)
    mean = total[0, 1:] / total[0, 0]
    return np.linalg.eigh(total[1:, 1:] / total[0, 0] - np.outer(mean, mean))[1].T[::-1].copy()


def rotated(q: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates, and the norm of the others."""
    all_ = q @ axes.T
    return all_[:, :LEAD], np.sqrt((all_[:, LEAD:] ** 2).sum(axis=1))


def stored(embeddings: DataFrame, axes: np.ndarray) -> DataFrame:
    """Integers, leading coordinates and residual norm of every kept vector."""

    def run(batches):
        for batch in batches:
            ids, q = kept(batch)
            lead, rest = rotated(q, axes)
            yield pa.RecordBatch.from_arrays([ids, binary_rows(q.astype("<i4")), binary_rows(lead.astype("<f8")), pa.array(rest)],
                                             names=["vec_id", "q", "lead", "rest"])

    return c.materialised(source(embeddings).mapInArrow(run, STORED), "vectors")


def binary_rows(matrix: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(matrix)
    offsets = np.arange(len(raw) + 1, dtype=np.int32) * (raw.shape[1] * raw.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def matrix(column: pa.Array, kind: str, size: int) -> np.ndarray:
    return np.frombuffer(c.text_bytes(column)[0].tobytes(), kind).reshape(-1, size)


class Centroids:
    """The centroids of a round, with their rotated coordinates."""

    def __init__(self, q: np.ndarray, axes: np.ndarray):
        self.q = q                                          # k x 64, whole
        self.lead, self.rest = rotated(q, axes)
        self.norms = (q.astype(float) ** 2).sum(axis=1)

    def nearest(self, q: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest centroid (of equal ones the least), the squared distance, and how many were measured."""
        own = (lead ** 2).sum(axis=1) + rest ** 2
        bound = ((lead ** 2).sum(axis=1)[:, None] - 2 * lead @ self.lead.T + (self.lead ** 2).sum(axis=1)
                 + (rest[:, None] - self.rest) ** 2 - MARGIN * (own[:, None] + self.norms + 1))
        rows = np.arange(len(q))
        far = np.full(bound.shape, np.iinfo(np.int64).max)
        first = bound.argmin(axis=1)
        far[rows, first] = ((q - self.q[first]) ** 2).sum(axis=1)
        bound[rows, first] = np.inf
        left, number = np.nonzero(bound <= far[rows, first][:, None])
        far[left, number] = ((q[left] - self.q[number]) ** 2).sum(axis=1)
        nearest = far.argmin(axis=1)
        return nearest, far[rows, nearest], len(q) + len(left)

    def of(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whole components, nearest centroid and distance of stored rows."""
        q = matrix(batch.column("q"), "<i4", SIZE).astype(np.int64)
        nearest, far, _ = self.nearest(q, matrix(batch.column("lead"), "<f8", LEAD), batch.column("rest").to_numpy())
        return q, nearest, far


def first_centroids(table: DataFrame, k: int) -> np.ndarray:
    """The vectors with the least sha256 of their number."""
    order = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    rows = table.select(order.alias("h"), "q").orderBy(F.asc_nulls_last("h"), "q").limit(k).collect()
    return np.array([np.frombuffer(bytes(r["q"]), "<i4") for r in rows], np.int64).reshape(-1, SIZE)


def moved(table: DataFrame, now: Centroids) -> np.ndarray:
    """Each centroid's floor of the mean of its vectors; without vectors it stays."""
    k = len(now.q)

    def sums(batches):
        total = np.zeros((k, SIZE + 1), np.int64)
        for batch in batches:
            q, nearest, _ = now.of(batch)
            np.add.at(total, nearest, np.hstack([q, np.ones((len(q), 1), np.int64)]))
        slot = np.flatnonzero(np.repeat(total[:, SIZE] > 0, SIZE + 1))
        if len(slot):
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total.ravel()[slot])], names=["slot", "value"])

    found = summed(table.mapInArrow(sums, "slot long, value long"))
    out = now.q.copy()
    for number in range(k):
        base = number * (SIZE + 1)
        if base in found:
            out[number] = [found[base + i] // found[base + SIZE] for i in range(SIZE)]
    return out


def clusters(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """Per vector: vec_id, cluster, distance; inertia of its cluster and of all, and a digest of its centroid."""
    spark = c.session(embeddings.sparkSession)
    axes = rotation(embeddings)
    if axes is None:
        return spark.createDataFrame([], RESULT + ", cluster_inertia long, inertia long, centroid_sha256 string")
    table = stored(embeddings, axes)
    now = Centroids(first_centroids(table, k), axes)
    for _ in range(rounds):
        now = Centroids(moved(table, now), axes)

    def assign(batches):
        for batch in batches:
            _, nearest, far = now.of(batch)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(nearest.astype(np.int32)), pa.array(far)],
                                             names=["vec_id", "cluster", "distance"])

    assigned = c.materialised(table.mapInArrow(assign, RESULT), "assigned", narrow=True)
    inertia = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()      # k rows
    every = sum(r["cluster_inertia"] for r in inertia)
    rows = [(r["cluster"], r["cluster_inertia"], every,
             hashlib.sha256(",".join(map(str, now.q[r["cluster"]].tolist())).encode()).hexdigest()) for r in inertia]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
