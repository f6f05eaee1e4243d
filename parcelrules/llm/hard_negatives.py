"""Hard negatives for anchors, from exact inner products of packed integers.

1. Components become floor(256 * x), as doubles, which hold them exactly.
2. Candidates are dealt evenly to parts, anchors (vec_id divisible by ``EVERY``) to tiles.
   A task holds one part's candidates and streams the anchors' tiles past them.
3. Kronecker packing. Both sides get a bias that makes every component non-negative. The biased
   components of several candidates are laid into separate bit fields of one wide integer, wide
   enough for a whole inner product; one multiplication by an anchor's component, summed over the components,
   gives the products of all its fields at once, which shifts and masks take apart. The
   wide integers are 53-bit ones (the whole numbers a double holds, so that BLAS multiplies
   them) if two fields or more fit; else Python integers of ``FIELDS`` fields.
4. First pass: each part names an anchor's best rows of its own label; a ranked
   merge keeps the first ``POSITIVES``. Second pass: with the positives' scores known, each part
   names the best rows of other labels below each upper limit; a merge keeps the first ``NEGATIVES``.

The work is anchors times rows, as the question is. A part's answer has a fixed number of
rows per anchor, so what is shuffled doesn't depend on how labels or scores are spread.

Defined cases: rows with a null label, a null vector or a component that is null or not
finite take no part; extra columns are not read. Shorter vectors count as filled with
zeros. A null vec_id is never an anchor, and comes after the others among equal scores; rows
that share an anchor's vec_id aren't its positives. Rows with one vec_id are rows of their own: each
is an anchor, or may be found. A positive whose score is below zero has no negatives. An empty table gives no rows.
Scores must fit a long, else the job ends with an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from parcelrules.llm import common as c, vectors

EVERY = 50
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95                # per cent of the positive's score
PART_ROWS = 1 << 16               # candidates in a part
TILE_ROWS = 1 << 10               # anchors in a tile
LEAST_PART = 1 << 9
TILE_CELLS = 1 << 22              # components in a tile at most, but one row at least
BLOCK = (256, 4096)               # anchors and candidates multiplied at once
EXACT = 53                        # bits of a whole number in a double
FIELDS = 16
NONE = np.iinfo(np.int64).min
TILE = "part int, tile long, size int, ids binary, known int, labels binary, kind string, q binary"


# --- packed products ------------------------------------------------------------------

def products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """All inner products of two matrices of whole numbers held as doubles, exactly, as longs."""
    size = anchors.shape[1]
    if not size or not len(anchors) or not len(candidates):
        return np.zeros((len(anchors), len(candidates)), np.int64)
    low_a, low_c = int(anchors.min()), int(candidates.min())
    high = size * (int(anchors.max()) - low_a) * (int(candidates.max()) - low_c)
    bits = max(high.bit_length(), 1)
    if 2 * bits <= EXACT and max(abs(low_a), abs(low_c)) < 1 << 24 and size < 1 << 12:
        a, b, fields = anchors - low_a, candidates - low_c, EXACT // bits
        return unpacked((a @ packed(b, bits, fields).T).astype(np.int64), bits, fields, len(b)) + (
            low_a * b.sum(axis=1).astype(np.int64) + (low_c * a.sum(axis=1).astype(np.int64))[:, None] + size * low_a * low_c)
    a, b = as_integers(anchors) - low_a, as_integers(candidates) - low_c
    exact = unpacked(a.dot(packed(b, bits, FIELDS).T), bits, FIELDS, len(b)) + (
        low_a * b.sum(axis=1) + (low_c * a.sum(axis=1))[:, None] + size * low_a * low_c)
    if max(abs(int(exact.max())), abs(int(exact.min()))) >= 1 << 62:
        raise ValueError("an inner product doesn't fit a long")
    return exact.astype(np.int64)


def as_integers(matrix: np.ndarray) -> np.ndarray:
    out = np.empty(matrix.shape, object)
    out.ravel()[:] = [int(x) for x in matrix.ravel().tolist()]
    return out


def packed(rows: np.ndarray, bits: int, fields: int) -> np.ndarray:
    """Each ``fields`` rows laid into one, ``bits`` apart."""
    room = -len(rows) % fields
    if room:
        rows = np.vstack([rows, np.zeros((room, rows.shape[1]), np.int64).astype(rows.dtype)])
    out = rows[0::fields]
    for f in range(1, fields):
        out = out + rows[f::fields] * (1 << bits * f)
    return out


def unpacked(sums: np.ndarray, bits: int, fields: int, n: int) -> np.ndarray:
    """The fields of packed sums, one column per packed row."""
    out = np.empty((len(sums), sums.shape[1] * fields), sums.dtype)
    for f in range(fields):
        out[:, f::fields] = (sums >> bits * f) & ((1 << bits) - 1)
    return out[:, :n]


# --- tiles ----------------------------------------------------------------------------

def row_table(embeddings: DataFrame) -> DataFrame:
    """vec_id, label (shifted where the id says so) and vector of the rows that have all but perhaps an id."""
    label = F.col("label").cast("long")
    number = F.col("vec_id").cast("long")
    return embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).select(
        number.alias("vec_id"), F.when(number % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), "embedding")


def tiles(rows: DataFrame, parts: int) -> DataFrame:
    """The rows dealt evenly to ``parts`` parts, each written as a few tiles in order of vec_id."""

    def cut(batches):
        part, made = TaskContext.get().partitionId(), 0
        held, cells, widest = [], 0, 0
        for batch in batches:
            flat, offsets, sound = vectors.whole_components(batch.column("embedding"))
            ids, labels = batch.column("vec_id"), batch.column("label").to_numpy(zero_copy_only=False)
            null, number = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy()
            for row in np.flatnonzero(sound):
                q = flat[offsets[row]:offsets[row + 1]]
                widest = max(widest, len(q))
                if held and (len(held) + 1) * widest > TILE_CELLS:
                    yield tile(held, part, made)
                    held, widest, made = [], len(q), made + 1
                held.append((bool(null[row]), int(number[row]), int(labels[row]), q))
        if held:
            yield tile(held, part, made)

    return rows.repartition(parts).mapInArrow(cut, TILE)


def tile(held: list[tuple], part: int, made: int) -> pa.RecordBatch:
    held.sort(key=lambda x: (x[0], x[1], x[2], x[3].tobytes()))
    size = max(len(x[3]) for x in held)
    q = np.zeros((len(held), size))
    for row, x in zip(q, held):
        row[:len(x[3])] = x[3]
    most = np.abs(q).max(initial=0)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    ids, labels = (np.array([x[i] for x in held], "<i8").tobytes() for i in (1, 2))
    return pa.RecordBatch.from_pydict(
        {"part": [part], "tile": [part << 32 | made], "size": [size], "ids": [ids], "known": [sum(not x[0] for x in held)], "labels": [labels],
         "kind": [kind], "q": [q.astype(kind).tobytes()]},
        pa.schema([("part", pa.int32()), ("tile", pa.int64()), ("size", pa.int32()), ("ids", pa.binary()), ("known", pa.int32()),
                   ("labels", pa.binary()), ("kind", pa.string()), ("q", pa.binary())]))


class Tile:
    """A tile read back: ids and labels, components on request."""

    def __init__(self, row: dict):
        self.number, self.size, self.known = row["tile"], row["size"], row["known"]
        self.ids, self.labels = (np.frombuffer(row[n], "<i8") for n in ("ids", "labels"))
        self.raw = np.frombuffer(row["q"], row["kind"]).reshape(len(self.ids), self.size)
        self.positives = row.get("positives") or []

    def doubles(self, low: int, high: int, size: int) -> np.ndarray:
        out = np.zeros((min(high, len(self.ids)) - low, size))
        out[:, :self.size] = self.raw[low:high]
        return out

    def id_array(self, places: np.ndarray) -> pa.Array:
        return pa.array(self.ids[places], pa.int64(), mask=places >= self.known)


# --- what a part answers ----------------------------------------------------------------

def order_keys(scores: np.ndarray) -> np.ndarray:
    """Keys that order each row's candidates by score, of equal ones the earlier column first (largest key first)."""
    n = scores.shape[1]
    if np.abs(scores).max(initial=0) < 1 << 48:
        return scores * n + np.arange(n - 1, -1, -1)
    keys = np.empty_like(scores)
    np.put_along_axis(keys, np.argsort(~scores, axis=1, kind="stable"), np.arange(n, 0, -1)[None, :].repeat(len(scores), 0), axis=1)
    return keys


def best(keys: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``k`` largest allowed keys, or all if fewer."""
    keys = np.where(allowed, keys, NONE)
    k = min(k, keys.shape[1])
    column = np.argpartition(keys, keys.shape[1] - k, axis=1)[:, -k:]
    row = np.arange(len(keys))[:, None].repeat(k, 1)
    hit = np.take_along_axis(keys, column, axis=1) != NONE
    return row[hit], column[hit]


def blocks(anchors: Tile, candidates: Tile):
    """(first anchor, first candidate, scores) of every block of two tiles."""
    size = max(anchors.size, candidates.size)
    for low_c in range(0, len(candidates.ids), BLOCK[1]):
        some = candidates.doubles(low_c, low_c + BLOCK[1], size)
        for low_a in range(0, len(anchors.ids), BLOCK[0]):
            yield low_a, low_c, products(anchors.doubles(low_a, low_a + BLOCK[0], size), some)


def firsts(group: np.ndarray, score: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Indices of the first ``k`` of each group, by score down and place up."""
    order = np.lexsort((place, ~score, group))
    of = group[order]
    rank = np.arange(len(of)) - np.searchsorted(of, of, "left")
    return order[rank < k]


def positives_of(anchors: Tile, candidates: Tile):
    found = []
    for low_a, low_c, scores in blocks(anchors, candidates):
        own, other = slice(low_a, low_a + len(scores)), slice(low_c, low_c + scores.shape[1])
        same_row = (anchors.ids[own, None] == candidates.ids[other]) & (np.arange(low_c, other.stop) < candidates.known)
        row, column = best(order_keys(scores), (anchors.labels[own, None] == candidates.labels[other]) & ~same_row, POSITIVES)
        found.append((row + low_a, scores[row, column], column + low_c))
    row, score, place = (np.concatenate(x) for x in zip(*found))
    take = firsts(row, score, place, POSITIVES)
    return {"tile": pa.array(np.full(len(take), anchors.number)), "row": pa.array(row[take].astype(np.int32)), "anchor_id": pa.array(anchors.ids[row[take]]),
            "positive_id": candidates.id_array(place[take]), "positive_score": pa.array(score[take])}


def negatives_of(anchors: Tile, candidates: Tile):
    n = len(anchors.ids)
    limits = np.full((POSITIVES, 2, n), NONE)                # upper, lower; NONE: no such positive
    about = {}
    for p in anchors.positives:
        about[p["rank"], p["row"]] = p
        if p["score"] >= 0:
            limits[p["rank"], :, p["row"]] = HIGH * p["score"] // 100, -(-LOW * p["score"] // 100)
    found = []
    for low_a, low_c, scores in blocks(anchors, candidates):
        own, other = slice(low_a, low_a + len(scores)), slice(low_c, low_c + scores.shape[1])
        keys, unlike = order_keys(scores), anchors.labels[own, None] != candidates.labels[other]
        for rank in range(POSITIVES):
            upper, lower = limits[rank, 0, own], limits[rank, 1, own]
            row, column = best(keys, unlike & (scores <= upper[:, None]) & (scores >= lower[:, None]) & (upper != NONE)[:, None], NEGATIVES)
            found.append(((row + low_a) * POSITIVES + rank, scores[row, column], column + low_c))
    group, score, place = (np.concatenate(x) for x in zip(*found))
    take = firsts(group, score, place, NEGATIVES)
    row, rank = group[take] // POSITIVES, group[take] % POSITIVES
    own = [about[k, r] for k, r in zip(rank.tolist(), row.tolist())]
    return {"tile": pa.array(np.full(len(take), anchors.number)), "row": pa.array(row.astype(np.int32)), "place": pa.array(rank.astype(np.int32)),
            "anchor_id": pa.array(anchors.ids[row]), "positive_id": pa.array([p["id"] for p in own], pa.int64()),
            "positive_score": pa.array([p["score"] for p in own], pa.int64()),
            "negative_id": candidates.id_array(place[take]), "negative_score": pa.array(score[take])}


def met(candidates: DataFrame, anchors: DataFrame, parts: int, answer, schema: str) -> DataFrame:
    """``answer(anchor tile, candidate tile)`` for every pair of tiles; a task streams anchors past its part's candidates."""
    none = F.lit(None).cast(dict(anchors.dtypes).get("positives", "int"))
    every = anchors.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("side", F.lit(1))
    both = candidates.withColumn("side", F.lit(0))
    if "positives" in anchors.columns:
        both = both.withColumn("positives", none)
    both = both.unionByName(every).repartition(parts, "part").sortWithinPartitions("part", "side", "tile")

    def run(batches):
        part, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["part"] != part:
                    part, held = row["part"], []
                if row["side"] == 0:
                    held.append(Tile(row))
                    continue
                anchors = Tile(row)
                for candidates in held:
                    yield pa.RecordBatch.from_pydict(answer(anchors, candidates))

    return both.mapInArrow(run, schema)


def ranked(found: DataFrame, group: list[str], score: str, number: str, k: int) -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1."""
    order = Window.partitionBy(*group).orderBy(F.col(score).desc(), F.col(number).asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def positives(candidates: DataFrame, anchors: DataFrame, parts: int) -> DataFrame:
    found = met(candidates, anchors, parts, positives_of, "tile long, row int, anchor_id long, positive_id long, positive_score long")
    return ranked(found, ["tile", "row"], "positive_score", "positive_id", POSITIVES)


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, as the module says."""
    spark = c.session(embeddings.sparkSession)
    cores = spark.sparkContext.defaultParallelism
    rows = row_table(embeddings)
    n = embeddings.count()
    parts = max(-(-n // PART_ROWS), min(2 * cores, -(-n // LEAST_PART)), 1)
    candidates = c.materialised(tiles(rows, parts), "candidates")
    chosen = rows.where(F.col("vec_id") % EVERY == 0)
    anchors = c.materialised(tiles(chosen, max(-(-n // EVERY // TILE_ROWS), 1)), "anchors")
    first = positives(candidates, anchors, parts).groupBy("tile").agg(F.collect_list(F.struct(
        (F.col("rank") - 1).alias("rank"), "row", F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("positives"))
    with_positives = c.materialised(anchors.join(first, "tile"), "positives")
    found = met(candidates, with_positives, parts, negatives_of, "tile long, row int, place int, anchor_id long, positive_id long, positive_score long, "
                                                                 "negative_id long, negative_score long")
    return ranked(found, ["tile", "row", "place"], "negative_score", "negative_id", NEGATIVES).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
