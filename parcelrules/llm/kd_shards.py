"""Sharding by a k-d tree over document metadata, DataFrame work only.

The points are the distinct texts, each with the bytes of all its copies and the
metadata of its first copy; so equal texts stay together. A text whose copies
weigh more than ``1 / COARSE`` of a shard is dealt into parts of about that
weight by doc_id, all at the same place, since no cut could balance it otherwise.

A node of the tree is cut at its weighted median along its widest dimension
(range over the root's range) until it holds the target bytes. Dimensions are
long numbers; an order of all points along a dimension is its value, then a hash.
The median is found by refinement: all nodes of a level at once count the bytes
of ``BUCKETS`` equal ranges of that order, keep the range where half the weight
is reached, and count again inside, until a range holds one point. A round is one
grouped sum with map-side combining; its result is bounded by nodes x ``BUCKETS``.

Slots number a shard's documents without gaps: counts of (shard, hash bucket)
give each bucket its first slot, and rows are numbered inside their bucket, so no
shard lies in one task.

Defined cases: a null text has size 1 and the checksum of no bytes; null metadata
sort as the least value; repeated rows are documents of their own; an empty table
gives no rows; a table of few documents may leave shards empty; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelrules.llm import common as c
from parcelrules.operators.skew import splittable

SHARDS = 16
COARSE = 16                # parts of a shard's bytes that one text may weigh
BUCKETS = 1 << 12
ROUNDS = 12                # BUCKETS ** ROUNDS covers any order of longs and hashes
SLOT_ROWS = 1 << 14        # rows numbered together, about
DIMENSIONS = ("n_chars", "source", "lang")


def coordinate(name: str, kind: str) -> Column:
    """A column as a number below 2 ** 30; null is 0."""
    value = F.col(f"`{name}`")
    if kind in ("string", "binary"):
        # Names often share their head, so their last characters give the place.
        tail = F.hex(F.right(value.cast("string"), F.lit(4)).cast("binary"))
        number = F.conv(F.left(F.concat(tail, F.lit("0" * 8)), F.lit(8)), 16, 10).cast("long")
        return F.coalesce(F.shiftright(number, 2) + 1, F.lit(0).cast("long"))
    return F.coalesce(F.least(F.greatest(value.cast("long"), F.lit(0).cast("long")), F.lit((1 << 30) - 2).cast("long")) + 1,
                      F.lit(0).cast("long"))


def with_text(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the text's identity and the coordinates."""
    shown = F.coalesce("text", F.lit(""))
    kinds = dict(docs.dtypes)
    dims = [coordinate(n, kinds[n]) if n in kinds else F.lit(0).cast("long") for n in DIMENSIONS]
    return docs.select(
        F.col("doc_id"), (F.octet_length(shown) + 1).cast("long").alias("size"), F.crc32(shown.cast("binary")).alias("text_crc32"),
        F.xxhash64(shown, F.octet_length(shown)).alias("text_key"), *[d.alias(f"d{i}") for i, d in enumerate(dims)])


def part_of(parts: Column) -> Column:
    """The part of a heavy text that a document belongs to."""
    return F.pmod(F.xxhash64(F.col("doc_id")), parts)


def points(rows: DataFrame, shard_bytes: int) -> DataFrame:
    """(text_key, part, weight, tie, d0, d1, ...): what the tree is built from."""
    dims = [f"d{i}" for i in range(len(DIMENSIONS))]
    texts = rows.groupBy("text_key").agg(
        F.sum("size").alias("bytes"), F.min(F.struct("doc_id", *dims)).alias("first"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("bytes") * COARSE / max(shard_bytes, 1))).cast("long")
    texts = texts.select("text_key", F.least(parts, F.lit(1 << 20)).alias("parts"), *[F.col(f"first.{d}").alias(d) for d in dims])
    own = rows.select("text_key", "doc_id", "size").join(splittable(texts, "text_key"), "text_key")
    return own.withColumn("part", part_of(F.col("parts"))).groupBy("text_key", "part", "parts", *dims).agg(
        F.sum("size").alias("weight")).withColumn("tie", F.xxhash64("text_key", "part").bitwiseAND((1 << 32) - 1))


def order_of(dim: Column) -> Column:
    """The place of a point along the cut dimension: value, then hash; below 2 ** 62."""
    value = F.element_at(F.array(*[F.col(f"d{i}") for i in range(len(DIMENSIONS))]), dim + 1)
    return F.call_function("shiftleft", value, F.lit(32)) + F.col("tie")


def levels(total: int, target: int) -> int:
    depth = 0
    while total > target * (1 << depth) and depth < 30:
        depth += 1
    return depth


def cut_level(placed: DataFrame, root: dict) -> DataFrame:
    """Points (node, ...) with their node of the next level."""
    n = len(DIMENSIONS)
    wide = [F.col(f"hi{i}") - F.col(f"lo{i}") for i in range(n)]
    share = [wide[i] / float(max(root[f"hi{i}"] - root[f"lo{i}"], 1)) for i in range(n)]
    # The widest dimension; of equals the first.
    best = F.array_max(F.array(*[F.struct(share[i].alias("share"), F.lit(-i).alias("i")) for i in range(n)]))["i"]
    nodes = placed.groupBy("node").agg(F.sum("weight").alias("total"), *[f(f"d{i}").alias(f"{k}{i}") for i in range(n)
                                                                        for k, f in (("lo", F.min), ("hi", F.max))])
    state = nodes.select("node", (-best).cast("int").alias("dim"), "total", F.lit(0).cast("long").alias("low"),
                         F.lit((1 << 62) - 1).cast("long").alias("high"), F.lit(0).cast("long").alias("below"))
    state = c.materialised(state, "kd-nodes", small=True)
    by_order = placed.select("node", "weight", *[f"d{i}" for i in range(n)], "tie")
    for _ in range(ROUNDS):
        if not state.where("high > low").limit(1).count():
            break
        inside = by_order.join(state.where("high > low"), "node").withColumn("at", order_of(F.col("dim"))).where("at BETWEEN low AND high")
        step = F.call_function("div", F.col("high") - F.col("low"), F.lit(BUCKETS)) + 1
        sums = inside.withColumn("bucket", F.call_function("div", F.col("at") - F.col("low"), step)).groupBy(
            "node", "dim", "total", "low", "high", "below", "bucket").agg(
            F.sum("weight").alias("weight"), F.min("at").alias("first"), F.max("at").alias("last"))
        # At most BUCKETS rows a node.
        run = F.sum("weight").over(Window.partitionBy("node").orderBy("bucket"))
        reached = sums.withColumn("upto", F.col("below") + run).where("2 * upto >= total").groupBy("node").agg(
            F.min(F.struct("bucket", "dim", "total", "first", "last", "upto", "weight")).alias("r"))
        # The range shrinks to its points; where it holds one, low = high is the cut.
        narrowed = reached.select("node", "r.dim", "r.total", F.col("r.first").alias("low"), F.col("r.last").alias("high"),
                                  (F.col("r.upto") - F.col("r.weight")).alias("below"))
        state = c.materialised(narrowed.unionByName(state.where("high = low")), "kd-nodes", small=True)
    # The point at the median goes to the side that leaves the halves nearer.
    at_cut = by_order.join(state, "node").where(order_of(F.col("dim")) == F.col("low")).groupBy("node").agg(F.sum("weight").alias("own"))
    cut = state.join(at_cut, "node").select("node", "dim", F.when(
        2 * F.col("below") + F.col("own") <= F.col("total"), F.col("low") + 1).otherwise(F.col("low")).alias("cut"))
    right = (order_of(F.col("dim")) >= F.col("cut")).cast("long")
    return placed.join(cut, "node").withColumn("node", 2 * F.col("node") + right).drop("dim", "cut")


def tree(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(text_key, part, parts, shard): the leaf of every point; shards are 0 to shards - 1, a power of two."""
    total = rows.agg(F.sum("size").alias("n")).collect()[0]["n"] or 0
    target = max(1, -(-total // shards))
    placed = c.materialised(points(rows, target).withColumn("node", F.lit(0).cast("long")), "kd-points", narrow=True)
    n = range(len(DIMENSIONS))
    root = placed.agg(*[F.coalesce(f(f"d{i}"), F.lit(0)).alias(f"{k}{i}") for i in n for k, f in (("lo", F.min), ("hi", F.max))]).collect()[0].asDict()
    for _ in range(levels(shards, 1) if total else 0):
        placed = c.materialised(cut_level(placed, root), "kd-points", narrow=True)
    return placed.select("text_key", "part", "parts", F.col("node").cast("int").alias("shard"))


def numbered(rows: DataFrame, group: str) -> DataFrame:
    """``rows`` (doc_id, ``group``, ...) with ``slot``, gapless from 0 in each group."""
    buckets = max(1, rows.count() // SLOT_ROWS)
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(buckets)))
    counts = dealt.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_first", F.sum("_n").over(Window.partitionBy(group).orderBy("_bucket")) - F.col("_n")).drop("_n")
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy(group, "_bucket").orderBy("doc_id", "text_key")))
    return ranked.join(before, [group, "_bucket"]).withColumn("slot", (F.col("_first") + F.col("_rank") - 1).cast("long")).drop(
        "_bucket", "_first", "_rank")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Every document with its shard and slot; shards hold nearly equal bytes."""
    rows = c.materialised(with_text(docs), "kd-rows", narrow=True)
    leaves = tree(rows, shards)
    parts = leaves.groupBy("text_key").agg(F.first("parts").alias("parts"))
    own = rows.join(splittable(parts, "text_key"), "text_key").withColumn("part", part_of(F.col("parts")))
    placed = own.join(splittable(leaves.select("text_key", "part", "shard"), "text_key", "part"), ["text_key", "part"])
    out = numbered(c.materialised(placed.select("doc_id", "text_key", "size", "text_crc32", "shard"), "kd-placed", narrow=True), "shard")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
