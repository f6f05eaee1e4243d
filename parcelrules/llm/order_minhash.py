"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is its sequence of lower-cased words. Its k-mers are five-word shingles,
labelled with their occurrence numbers, so that repeats count. Each of ``SKETCHES``
seeds picks the ``PICKED`` labelled shingles of least hash and keeps them in text
order; texts with an equal pick meet in a bucket. With picks in order, meeting is
the likelier the smaller the edit distance, not only the larger the overlap. One edit
breaks five shingles, too many of a short text's: texts of up to ``SHORT`` words also
pick ``WORDS_PICKED`` labelled words for each of ``WORD_SKETCHES`` seeds.

Two texts of n and m words are near when their alignment matches M words in
order with M / (n + m - M) >= ``LEAST``. So are all texts whose aligned shingles reach
that share, and also those in which scattered edits break more shingles than words. The
measure is 1 less a metric (the biotope transform of the edit distance), which the
search uses below. The alignment is the bit-parallel longest common subsequence in the
band that texts near enough can't leave, so it is exact for them.

A bucket of near copies may hold a third of all texts, so no bucket is expanded
into its pairs. First each text meets its bucket's pivot, the text with most company
in all its buckets, for ``STARS`` rounds; what a round joins, or shows to be out
of reach of any text left (by the triangle inequality), leaves the bucket. Then
the bucket's guests, the texts outside its largest class, are compared with all
texts left, in blocks of ``BLOCK`` by ``BLOCK`` texts: a task counts the words in
common and aligns what could be near, and only links leave it. So no link between
texts that share a bucket is lost. ``chance`` tells how likely a pair is to share one.

Exact copies are one text throughout. Defined cases: a null or empty text is
alone in its class, whose id is its doc_id; a text under five words has no
shingles and is near its exact copies only; a class's id is its least doc_id,
null if all are null; repeated rows are copies; ``one_of_each`` keeps the columns
it gets, whatever they are named.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parcelrules.llm import common as c
from parcelrules.llm.components import components
from parcelrules.operators.skew import splittable

SHINGLE = 5
SKETCHES = 24
PICKED = 3
SHORT = 40              # words; a text of 32 is near none of more
WORD_SKETCHES = 12
WORDS_PICKED = 4
LEAST = 0.8
STARS = 2
BLOCK = 256
LABEL = np.uint64(0xD6E8FEB86659FD93)
SEEDS = c.mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


# --- in the tasks -------------------------------------------------------------------

def word_rows(column: pa.Array):
    """Per text the hashes of its words and of its shingles."""
    raw, offsets = c.text_bytes(column)
    for low, high in c.slices(offsets):
        data = c.ASCII_LOWER[raw[offsets[low]:offsets[high]]]
        starts, ends, first = c.word_bounds(data, offsets[low:high + 1] - offsets[low], c.NO_WORD)
        words = c.range_hashes(data, starts, ends)
        runs = c.run_hashes(words, SHINGLE)
        for a, b in zip(first[:-1], first[1:]):
            yield words[a:b], runs[a:max(a, b - SHINGLE + 1)]


def labelled(mers: np.ndarray) -> np.ndarray:
    """The words or shingles with their occurrence numbers mixed in."""
    order = np.argsort(mers, kind="stable")
    ranked = mers[order]
    begin = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    number = np.empty(len(mers), np.uint64)
    number[order] = np.arange(len(mers)) - np.repeat(begin, np.diff(np.append(begin, len(mers))))
    return c.mix(mers + number * LABEL)


def sketch(mers: np.ndarray, seeds: np.ndarray, picked: int) -> list[int]:
    """One bucket key per seed; none without words or shingles."""
    if not len(mers):
        return []
    own = labelled(mers)
    keys = []
    for seed in seeds:
        h = c.mix(own ^ seed)
        pick = np.sort(np.argpartition(h, picked)[:picked]) if len(h) > picked else np.arange(len(h))
        key = np.uint64(len(pick))
        for x in own[pick]:
            key = c.mix(np.array([key ^ x]))[0]
        keys.append(int(key.view(np.int64)) or 1)
    return keys


def sketches(columns: list[np.ndarray], seeds: np.ndarray, picked: int) -> list[list[int]]:
    """``sketch`` of many texts; the keys of texts with over ``picked`` words or shingles are made together."""
    picks, owner, out = [], [], [[] for _ in columns]
    for i, mers in enumerate(columns):
        if len(mers) <= picked:
            out[i] = sketch(mers, seeds, picked)
            continue
        own = labelled(mers)
        if len(own) <= 1 << 14:
            h = c.mix(own[None, :] ^ seeds[:, None])
            at = np.sort(np.argpartition(h, picked, axis=1)[:, :picked], axis=1)
        else:
            at = np.array([np.sort(np.argpartition(c.mix(own ^ seed), picked)[:picked]) for seed in seeds])
        picks.append(own[at])
        owner.append(i)
    if picks:
        x = np.stack(picks)
        key = np.full(x.shape[:2], picked, np.uint64)
        for k in range(picked):
            key = c.mix(key ^ x[:, :, k])
        key[key == 0] = 1
        for i, row in zip(owner, key.view(np.int64).tolist()):
            out[i] = row
    return out


def text_keys(rows: list[tuple[np.ndarray, np.ndarray]]) -> list[list[int]]:
    """All bucket keys of texts given by words and shingles: by shingles, then by words, 0 where a text has none of these."""
    by_run = sketches([runs for _, runs in rows], SEEDS, PICKED)
    by_word = sketches([words if SHINGLE <= len(words) <= SHORT else words[:0] for words, _ in rows], SEEDS[:WORD_SKETCHES], WORDS_PICKED)
    return [a + (b or [0] * WORD_SKETCHES) if a else [] for a, b in zip(by_run, by_word)]


def chance(one: np.ndarray, other: np.ndarray, seeds: int, picked: int) -> float:
    """The chance that texts with these words or shingles share one of ``seeds`` buckets, if what they share stands in one order."""
    if min(len(one), len(other)) < picked:
        return float(len(one) == len(other) and bool((one == other).all()))
    both = np.intersect1d(labelled(one), labelled(other), assume_unique=True).size
    united = len(one) + len(other) - both
    return 1 - (1 - math.comb(both, picked) / math.comb(united, picked)) ** seeds


def matched(a: np.ndarray, b: np.ndarray, width: int) -> int:
    """The longest common subsequence over pairs of positions at most ``width`` apart, bit-parallel.

    Bit k of ``row`` stands for the column i - width + k of row i; a zero bit is
    a column where the length grows. The window moves one column a row.
    """
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b.tolist()):
        places.setdefault(x, []).append(j)
    whole = {x: sum(1 << j for j in js) for x, js in places.items() if len(js) > 64}
    size = 2 * width + 1
    full, top = (1 << size) - 1, 1 << (size - 1)
    row, grown = full, 0
    for i, x in enumerate(a.tolist()):
        low = i - width
        if x in whole:
            hits = (whole[x] >> low if low >= 0 else whole[x] << -low) & full
        else:
            hits = 0
            js = places.get(x)
            if js:
                for j in js[bisect_left(js, low):bisect_right(js, i + width)]:
                    hits |= 1 << (j - low)
        if hits:
            u = row & hits
            row = ((row + u) | (row - u)) & full
        grown += not row & 1
        row = row >> 1 | top
    return grown + size - row.bit_count()


def reach(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Bounds of the distance of two texts' words; both the distance itself where it is at most 1 - LEAST."""
    n, m = len(a), len(b)
    if not n or not m:
        return 1.0, 1.0
    most = np.intersect1d(labelled(a), labelled(b), assume_unique=True).size
    near = 1 - most / (n + m - most)
    if near > 1 - LEAST + 1e-12:
        return near, 1.0
    short = min(n, m)
    same = a[:short] == b[:short]
    head = short if same.all() else int(np.argmin(same))
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    same = a[::-1][:short] == b[::-1][:short]
    tail = short if same.all() else int(np.argmin(same))
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    # Texts near enough have this many insertions and deletions at most, so their paths stay in the band.
    edits = int((n + m) * (1 - LEAST) / (1 + LEAST) + 1e-9)
    total = head + tail + (matched(a, b, max(edits, 1)) if len(a) and len(b) else 0)
    exact = 1 - total / (n + m - total)
    return (exact, exact) if exact <= 1 - LEAST + 1e-12 else (min(near, exact), 1.0)


# --- on the cluster -----------------------------------------------------------------

def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes, one row each."""
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("node"))
    wanted = own.join(c.slim(nodes, nodes.count()), ["node"], "left_semi")
    first = wanted.groupBy("node").agg(F.min("doc_id").alias("least"))
    both = wanted.join(splittable(first, "node"), "node").where(F.col("doc_id").eqNullSafe(F.col("least")))
    return both.groupBy("node").agg(F.first("text").alias("text"))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (p, x) with the bounds ``low`` and ``high`` of their distance."""
    left = texts.select(F.col("node").alias("p"), F.col("text").alias("pt"))
    right = texts.select(F.col("node").alias("x"), F.col("text").alias("xt"))
    both = pairs.join(splittable(left, "p"), "p").join(splittable(right, "x"), "x").select("p", "x", "pt", "xt")

    def align(batches):
        for batch in batches:
            bounds = [reach(a, b) for (a, _), (b, _) in zip(word_rows(batch.column("pt")), word_rows(batch.column("xt")))]
            yield pa.RecordBatch.from_arrays([batch.column("p"), batch.column("x"), pa.array([x[0] for x in bounds], pa.float64()),
                                              pa.array([x[1] for x in bounds], pa.float64())], names=["p", "x", "low", "high"])

    # Dealt out anew, so that a hot pivot's comparisons are spread over all tasks.
    return both.repartition(F.xxhash64("p", "x")).mapInArrow(align, "p long, x long, low double, high double")


def block_links(own: DataFrame, keys: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges (a, b) between a bucket's guests and all its texts; ``own``: seed, key, node, low, high, root."""
    bucket = ["seed", "key"]
    by_root = own.groupBy(*bucket, "root").agg(F.count(F.lit(1)).alias("n"))
    sizes = by_root.groupBy(*bucket).agg(F.sum("n").alias("size"), F.max(F.struct("n", "root")).alias("host")).where(
        F.col("host.n") < F.col("size")).select(*bucket, "size", F.col("host.root").alias("host"), (F.col("size") - F.col("host.n")).alias("guests"))
    rows = c.materialised(own.join(splittable(sizes, *bucket), bucket), "guests", narrow=True)
    across, down = F.ceil(F.col("size") / BLOCK), F.ceil(F.col("guests") / BLOCK)
    x = rows.where("root <> host").select("*", F.pmod(F.hash("node"), down).alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), across - 1)).alias("i"),
                                          F.lit(True).alias("guest"))
    y = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), down - 1)).alias("j"), F.pmod(F.xxhash64("node"), across).alias("i"),
                    F.lit(False).alias("guest"))
    columns = ["seed", "key", "i", "j", "guest", "node", "root", "low", "high"]
    both = x.select(*columns).unionByName(y.select(*columns))
    wanted = rows.select("node").distinct()
    held = c.materialised(texts.join(wanted, "node", "left_semi").join(keys, "node"), "guest-texts")
    full = both.join(splittable(held, "node"), "node")

    def compare(block: pa.Table) -> pa.Table:
        guest = np.asarray(block.column("guest").to_numpy(zero_copy_only=False), bool)
        node, root, low, high = (block.column(n).to_numpy() for n in ("node", "root", "low", "high"))
        seed = block.column("seed")[0].as_py()
        keys = np.array(block.column("keys").to_pylist(), np.int64)
        text = block.column("text").combine_chunks()
        words = [own for own, _ in word_rows(text.chunk(0) if isinstance(text, pa.ChunkedArray) else text)]
        mine, theirs = np.flatnonzero(guest), np.flatnonzero(~guest)
        size = np.array([len(w) for w in words])
        held = np.concatenate([labelled(words[t]) for t in theirs])
        order = np.argsort(held)
        held, owner = held[order], np.repeat(np.arange(len(theirs)), size[theirs])[order]
        near, found = 1 - LEAST + 1e-12, []
        for g in mine:
            # A pair is compared in the first of its buckets only.
            may = (root[theirs] != root[g]) & (low[theirs] - high[g] <= near) & (low[g] - high[theirs] <= near) & (
                np.minimum(size[theirs], size[g]) >= (1 - near) * np.maximum(size[theirs], size[g])) & (
                ((keys[theirs] == keys[g]) & (keys[g] != 0)).argmax(1) == seed)
            if not may.any():
                continue
            own = labelled(words[g])
            begin, end = np.searchsorted(held, own, "left"), np.searchsorted(held, own, "right")
            count = end - begin
            at = np.arange(int(count.sum())) + np.repeat(begin - np.cumsum(count) + count, count)
            most = np.bincount(owner[at], minlength=len(theirs))
            may &= most >= (1 - near) * (size[theirs] + size[g] - most)
            found += [(int(node[g]), int(node[t])) for t in theirs[may] if reach(words[g], words[t])[1] <= near]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return full.groupBy("seed", "key", "i", "j").applyInArrow(compare, "a long, b long")


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sketch table (doc_id, node) and edges (a, b) that join each class's texts: those of the last comparison as they are, those before by their roots."""
    near = 1 - LEAST + 1e-12

    def run(batches):
        for batch in batches:
            keys = text_keys(list(word_rows(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"),
                                              pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "node", "keys"])

    sketched = c.materialised(docs.where(F.octet_length("text") > 0).select("doc_id", F.xxhash64("text").alias("node"), "text")
                              .mapInArrow(run, "doc_id long, node long, keys array<long>"), "sketches")
    bucket = sketched.groupBy("node").agg(F.first("keys").alias("keys")).select(
        "node", F.posexplode("keys").alias("seed", "key")).where("key <> 0")
    # A bucket is a seed's key; it stays while two texts of it may still be linked.
    crowd = bucket.groupBy("seed", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    crowded = c.materialised(bucket.join(splittable(crowd, "seed", "key"), ["seed", "key"]), "buckets", narrow=True)
    company = crowded.groupBy("node").agg(F.sum("size").alias("company"))
    active = c.materialised(crowded.join(company, "node").select(
        "seed", "key", "node", "company", F.lit(0.0).alias("low"), F.lit(1.0).alias("high")), "buckets", narrow=True)
    texts = c.materialised(texts_of(docs, active.select("node").distinct()), "near-texts")
    done = None
    for _ in range(STARS):
        pivots = active.groupBy("seed", "key").agg(F.max(F.struct("company", "node"))["node"].alias("p"))
        met = active.drop("low", "high").join(splittable(pivots, "seed", "key"), ["seed", "key"]).where("node <> p")
        pairs = met.select("p", F.col("node").alias("x")).distinct()
        found = c.materialised(verified(pairs, texts), "verified", narrow=True)
        edges = found.where(F.col("high") <= near).select(F.col("p").alias("a"), F.col("x").alias("b"))
        done = edges if done is None else done.unionByName(edges)
        told = met.join(found.select("p", F.col("x").alias("node"), "low", "high"), ["p", "node"])
        # Of a bucket, what isn't linked to the pivot stays, and of the linked what those may still reach.
        left = told.where(F.col("high") > near).groupBy("seed", "key").agg(F.min("low").alias("nearest"))
        active = c.materialised(told.join(splittable(left, "seed", "key"), ["seed", "key"]).where(
            (F.col("high") > near) | (F.col("nearest") - F.col("high") <= near)).select("seed", "key", "node", "company", "low", "high"), "buckets", narrow=True)
    roots = components(done)
    own = active.join(splittable(roots, "node"), "node", "left").select(
        "seed", "key", "node", "low", "high", F.coalesce("root", "node").alias("root"))
    last = block_links(own, sketched.groupBy("node").agg(F.first("keys").alias("keys")), texts)
    # The roots stand for the edges they were made of, so that these need not be joined a second time.
    return sketched.select("doc_id", "node"), roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(last)


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id and class_docs, the number of documents in the class."""
    named, edges = links(docs.select(F.col("doc_id").cast("long"), "text"))
    roots = components(edges)
    nodes = named.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    rooted = nodes.join(splittable(roots, "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    made = rooted.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_docs"))
    by_node = rooted.select("node", "root").join(splittable(made, "root"), "root").select("node", "class_id", "class_docs")
    found = named.join(splittable(by_node, "node"), "node").select("doc_id", "class_id", "class_docs")
    alone = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) == 0).select(
        F.col("doc_id").cast("long"), F.col("doc_id").cast("long").alias("class_id"), F.lit(1).cast("long").alias("class_docs"))
    return found.unionByName(alone)


@c.shielding
def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each class, that with the least doc_id; texts without bytes all stay. Same columns."""
    named, edges = links(docs.select(F.col("doc_id").cast("long"), "text"))
    roots = components(edges)
    nodes = named.groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = nodes.join(splittable(roots, "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Least doc_id, nulls last; of texts with one doc_id, the least hash.
    kept = rooted.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "node")).alias("k")).select(
        F.col("k.node").alias("_node"), F.col("k.least").alias("_least"))
    own = docs.withColumn("_node", F.xxhash64("text"))
    empty = own.where(F.coalesce(F.octet_length("text"), F.lit(0)) == 0).drop("_node")
    found = own.where(F.octet_length("text") > 0).join(c.slim(kept, kept.count()), (own["_node"] == kept["_node"]) & own["doc_id"].cast(
        "long").eqNullSafe(kept["_least"]), "left_semi")
    # Rows repeated with one doc_id and text: one stays. Only those are grouped whole.
    twice = named.groupBy("node", "doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.col("node").alias("_node"), F.col("doc_id").alias("_id"))
    own_twice = (found["_node"] == twice["_node"]) & found["doc_id"].cast("long").eqNullSafe(twice["_id"])
    size = twice.count()
    single = found.join(c.slim(twice, size), own_twice, "left_anti").select(*docs.columns)
    names = [f"c{i}" for i in range(len(docs.columns))]
    repeated = found.join(c.slim(twice, size), own_twice, "left_semi").select(*[F.col(f"`{n}`").alias(x) for n, x in zip(
        docs.columns, names)], "_node").groupBy("_node").agg(*[F.first(x).alias(x) for x in names])
    return single.unionByName(empty).union(repeated.select(*[F.col(x).alias(n) for n, x in zip(docs.columns, names)]))
