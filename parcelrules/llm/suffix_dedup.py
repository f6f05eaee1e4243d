"""Removal of repeated strings, by suffix sorting of the places that may repeat.

A byte goes if a string of ``SPAN`` bytes that covers it also starts earlier: in
a document before (by doc_id), or before in its own document.

1. Exact copies. Of equal texts the one with the least doc_id stays; the others
   go whole, if they have ``SPAN`` bytes, and take no further part.
2. Anchors. Each string of ``SPAN`` bytes has one anchor, the least hash of its
   ``GRAM``-byte substrings, which depends on the string alone. So two equal strings
   have anchors with equal hashes at the same place inside. Hashes are counted over
   all texts, and places whose hash occurs once are done with.
3. Suffix sorting. The rest bring what lies around them: up to ``SPAN`` bytes from the
   anchor on, and ``REACH`` before it. Both sides are sorted as suffixes (the left
   ones read backwards) by deep-shallow sorting: multikey quicksort on eight bytes
   at a time to a depth of ``SHALLOW`` bytes, then a blind trie for each group that
   still agrees. The common prefixes of neighbours give classes of equal strings for
   every length; of each class of ``SPAN``-byte strings all but the first are repeats.
4. An anchor with more than ``HOT`` places isn't sorted in one task: its strings are
   told apart by two 64-bit hashes, counted and marked by a shuffled join instead.

Defined cases: a null text is empty; a null doc_id comes after all others; rows with
equal doc_id and equal text are one document and get the same result; documents
with one doc_id and different texts are ordered by a hash of the text; only doc_id
and text are used.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parcelrules.llm import common as c
from parcelrules.llm.bloom_lm import LevelFilter, build_filter
from parcelrules.operators.skew import splittable

SPAN = 100
GRAM = 32
REACH = SPAN - GRAM               # an anchor lies at most so far inside a string
SHALLOW = 4                       # eight-byte words that multikey quicksort looks at
HOT = 100_000
BLOCK_ROWS = 50_000
FILTER_BITS = 1 << 27             # 16 MB; a fuller filter passes more, which the join then sorts out
PLACE_BITS = np.uint64(23)
CHUNK = 1 << 19                   # bytes hashed at once


# --- anchors ------------------------------------------------------------------------

def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """The hash of the ``size`` bytes from every position on."""
    up, down = c.powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(c.BYTE_VALUE[data] * up[:len(data)], out=sums[1:])
    n = len(data) - size + 1
    return c.mix((sums[size:] - sums[:n]) * down[:n])


def anchors(data: np.ndarray, offsets: np.ndarray):
    """Per chunk: positions of the anchors of all strings of SPAN bytes that lie within a row, and their hashes."""
    last = -1
    for low in range(0, max(len(data) - SPAN + 1, 0), CHUNK):
        part = data[low:low + CHUNK + SPAN - 1]
        h = gram_hashes(part)
        # The least hash, of equal ones the first: the position stands in the low bits.
        key = (h >> PLACE_BITS << PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
        width = 1
        least = key
        while 2 * width <= REACH + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = REACH + 1 - width
        least = np.minimum(least[:len(least) - rest], least[rest:]) if rest else least
        # least[j] is for the string that starts at j; those across rows don't count.
        start = np.arange(low, low + len(least))
        row = np.searchsorted(offsets, start, "right") - 1
        inside = start + SPAN <= offsets[row + 1]
        found = (least[inside] & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
        found = found[np.append(True, found[1:] != found[:-1])] if len(found) else found
        found = found[found + low > last]                      # a chunk may find the last one's anchor again
        if len(found):
            last = int(found[-1]) + low
            yield found + low, h[found]


def anchor_slices(column: pa.Array):
    """Per chunk of a slice of texts: first row, positions (from each text's start), hashes and rows of the anchors."""
    raw, offsets = c.text_bytes(column)
    for low, high in c.slices(offsets):
        rows = offsets[low:high + 1] - offsets[low]
        for place, hash_ in anchors(raw[offsets[low]:offsets[high]], rows):
            row = np.searchsorted(rows, place, "right") - 1
            yield low, place - rows[row], hash_, row + low


# --- deep-shallow sorting -------------------------------------------------------------

class BlindTrie:
    """Orders strings with a long common prefix, looking at branching bytes first and at one string after."""

    def __init__(self, text: list[bytes]):
        self.text = text
        self.root: list | int | None = None       # inner node: [depth, {byte: child}], leaf: list of strings

    def common(self, a: int, b: int) -> int:
        x, y = self.text[a], self.text[b]
        if x == y:
            return len(x)
        different = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
        return len(x) - (different.bit_length() + 7) // 8

    def add(self, k: int) -> None:
        if self.root is None:
            self.root = (k,)
            return
        own, node, path = self.text[k], self.root, []
        while isinstance(node, list):
            path.append(node)
            node = node[1].get(own[node[0]]) or next(iter(node[1].values()))
        agree = self.common(k, node[0])
        if agree == len(own):
            node_with = (*node, k)
            self.put(path, own, node, node_with)
            return
        # The deepest node on the path that ends before the first difference.
        above, below = None, self.root
        for at in path:
            if at[0] >= agree:
                below = at
                break
            above = at
            below = at[1].get(own[at[0]])
        if isinstance(below, list) and below[0] == agree:
            below[1][own[agree]] = (k,)
            return
        if below is None:
            above[1][own[above[0]]] = (k,)
            return
        split = [agree, {self.text[node[0]][agree]: below, own[agree]: (k,)}]
        if above is None:
            self.root = split
        else:
            above[1][own[above[0]]] = split

    def put(self, path: list, own: bytes, old: tuple, new: tuple) -> None:
        if path:
            path[-1][1][own[path[-1][0]]] = new
        else:
            self.root = new

    def order(self) -> list[tuple[int, int]]:
        """(string, length it shares with the string before it)."""
        out: list[tuple[int, int]] = []
        stack = [(self.root, 0)]
        while stack:
            node, shared = stack.pop()
            if isinstance(node, list):
                children = [node[1][b] for b in sorted(node[1])]
                for i in range(len(children) - 1, -1, -1):
                    stack.append((children[i], node[0] if i else shared))
            else:
                out.append((node[0], shared))
                out += [(k, len(self.text[k])) for k in node[1:]]
        return out


def deep_shallow(text: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of strings of ``width`` bytes (a multiple of 8), and what each shares with the one before it, in bytes."""
    words = np.frombuffer(b"".join(text), ">u8").reshape(len(text), width // 8).astype(np.uint64)
    order, shared = [], []
    stack = [(np.arange(len(text)), 0, 0)]
    while stack:
        group, depth, before = stack.pop()
        if len(group) == 1:
            order.append(int(group[0]))
            shared.append(before)
        elif depth == min(SHALLOW, words.shape[1]):
            trie = BlindTrie(text)
            for k in group.tolist():
                trie.add(k)
            found = trie.order()
            order += [k for k, _ in found]
            shared += [before, *[n for _, n in found[1:]]]
        else:
            at = words[group, depth]
            pivot = at[len(at) // 2]
            less, more = at < pivot, at > pivot
            # The stack gives the smaller words first; what parts two groups is set below.
            for part, deeper in ((more, 0), (~(less | more), 1), (less, 0)):
                if part.any():
                    stack.append((group[part], depth + deeper, -1))
    order, shared = np.array(order), np.array(shared)
    # Neighbours that quicksort parted differ within the shallow words.
    loose = np.flatnonzero(shared < 0)
    loose = loose[loose > 0]
    if len(loose):
        a, b = words[order[loose]], words[order[loose - 1]]
        word = (a != b).argmax(1)
        bits = a[np.arange(len(loose)), word] ^ b[np.arange(len(loose)), word]
        high = np.zeros(len(loose), np.int64)
        for shift in (32, 16, 8):
            big = (bits >> np.uint64(shift)) > 0
            high += np.where(big, shift, 0)
            bits = np.where(big, bits >> np.uint64(shift), bits)
        shared[loose] = word * 8 + 7 - high // 8
    shared[0] = 0
    return order, shared


def classes(text: list[bytes], width: int, lengths: range) -> dict[int, np.ndarray]:
    """For each length, numbers that are equal for strings with an equal prefix of that length."""
    order, shared = deep_shallow(text, width)
    out = {}
    for n in lengths:
        number = np.empty(len(text), np.int64)
        number[order] = np.cumsum(shared < n)
        out[n] = number
    return out


def repeats(left: list[bytes], right: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For anchors in document order: the bytes before and behind each that are repeats (0, 0: none).

    ``left`` are the bytes before the anchor, ``right`` those from it on.
    """
    n = len(left)
    before, behind = np.zeros(n, np.int64), np.zeros(n, np.int64)
    has_left, has_right = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    # Anchors with equal surroundings: all but the first are repeats throughout.
    number: dict[tuple[bytes, bytes], int] = {}
    first = np.array([number.setdefault(x, i) for i, x in enumerate(zip(left, right))])
    again = first != np.arange(n)
    most, least = np.minimum(REACH, has_left), np.maximum(SPAN - has_right, 0)
    whole = again & (least <= most)
    before[whole], behind[whole] = most[whole], SPAN - least[whole]
    own = np.flatnonzero(~again)
    if len(own) < 2:
        return before, behind
    wide, back = -(-SPAN // 8) * 8, -(-REACH // 8) * 8
    by_right = classes([right[i].ljust(wide, b"\0") for i in own], wide, range(GRAM, SPAN + 1))
    by_left = classes([left[i][::-1].ljust(back, b"\0") for i in own], back, range(REACH + 1))
    fits_left, fits_right = has_left[own], has_right[own]
    low, high = np.full(len(own), SPAN), np.full(len(own), -1)
    for inside in range(REACH + 1):
        valid = np.flatnonzero((fits_left >= inside) & (fits_right >= SPAN - inside))
        key = by_right[SPAN - inside][valid] * (len(own) + 1) + by_left[inside][valid]
        _, start, of = np.unique(key, return_index=True, return_inverse=True)
        later = valid[start[of] != np.arange(len(valid))]
        low[later] = np.minimum(low[later], inside)
        high[later] = np.maximum(high[later], inside)
    hit = high >= 0
    before[own[hit]], behind[own[hit]] = high[hit], SPAN - low[hit]
    return before, behind


# --- on the cluster -------------------------------------------------------------------

PLACE = "hash long, node long, none boolean, doc long, place long, hot boolean"
AROUND = "hash long, node long, none boolean, doc long, place long, before binary, behind binary"
RANGE = "node long, start long, end long"


def firsts(docs: DataFrame) -> DataFrame:
    """node, none, doc and text of each text's first document, if long enough to hold a string."""
    own = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("node"), "text").where(F.octet_length("text") >= SPAN)
    many = copies(docs)
    side = c.slim(many, many.count())
    both = own.join(side, "node", "left").where(F.col("copied").isNull() | F.col("doc").eqNullSafe(F.col("first")))
    return both.select("node", F.col("doc").isNull().alias("none"), "doc", "text")


def copies(docs: DataFrame) -> DataFrame:
    """(node, first, copied) of texts that several rows have."""
    own = docs.select("doc_id", F.xxhash64("text").alias("node"), F.octet_length("text").alias("n")).where(F.col("n") >= SPAN)
    return own.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id"))["doc_id"].alias("first"), F.count(F.lit(1)).alias("n")) \
        .where("n > 1").select("node", "first", F.lit(True).alias("copied"))


def anchor_counts(texts: DataFrame) -> DataFrame:
    """(key, count) of all anchors' hashes."""

    def run(batches):
        for batch in batches:
            for _, _, hash_, _ in anchor_slices(batch.column("text")):
                keys, n = np.unique(hash_, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "count"])

    return texts.select("text").mapInArrow(run, "key long, count long").groupBy("key").agg(F.sum("count").alias("count"))


def repeated_places(texts: DataFrame, hot: int) -> DataFrame:
    """The places of anchors whose hash occurs more than once."""
    spark = texts.sparkSession
    many = c.materialised(anchor_counts(texts).where("count > 1"), "anchors", narrow=True)
    likely = spark.sparkContext.broadcast(build_filter(many.select("key", F.lit(1).cast("long").alias("count")), FILTER_BITS, True))

    def run(batches):
        levels: LevelFilter = likely.value
        for batch in batches:
            node, none, doc = (batch.column(n) for n in ("node", "none", "doc"))
            for _, place, hash_, row in anchor_slices(batch.column("text")):
                may = levels.levels(hash_) > 0
                take = pa.array(row[may])
                yield pa.RecordBatch.from_arrays([pa.array(hash_[may].view(np.int64)), node.take(take), none.take(take), doc.take(take),
                                                  pa.array(place[may])], names=["hash", "node", "none", "doc", "place"])

    found = texts.mapInArrow(run, "hash long, node long, none boolean, doc long, place long")
    kept = many.select(F.col("key").alias("hash"), (F.col("count") > hot).alias("hot"))
    return found.join(splittable(kept, "hash"), "hash").select("hash", "node", "none", "doc", "place", "hot")


def removed_ranges(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(node, start, end): byte ranges of first copies that are repeats; they may overlap."""
    texts = firsts(docs)
    places = c.materialised(repeated_places(texts, hot).groupBy("node", "none", "doc").agg(
        F.array_sort(F.collect_set(F.struct("place", "hash", "hot"))).alias("places")), "places")
    wanted = places.select("node").distinct()
    near = texts.join(c.slim(wanted, wanted.count()), "node", "left_semi").select("node", "text").join(
        places.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node")).drop("_node")
    return sorted_ranges(near).unionByName(hot_ranges(near))


def surroundings(batch: pa.RecordBatch, hot: bool):
    """(row, text bytes, place, hash) of the batch's hot or other anchors."""
    for row, (text, places) in enumerate(zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("places").to_pylist())):
        for p in places:
            if p["hot"] == hot:
                yield row, text, p["place"], p["hash"]


def sorted_ranges(near: DataFrame) -> DataFrame:
    """Ranges by suffix sorting, anchors of one hash together."""

    def around(batches):
        for batch in batches:
            rows, before, behind, place, hash_ = [], [], [], [], []
            for row, text, at, key in surroundings(batch, False):
                rows.append(row)
                place.append(at)
                hash_.append(key)
                before.append(text[max(0, at - REACH):at])
                behind.append(text[at:at + SPAN])
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(hash_, pa.int64()), *[batch.column(n).take(take) for n in ("node", "none", "doc")], pa.array(place, pa.int64()),
                 pa.array(before, pa.binary()), pa.array(behind, pa.binary())], names=[x.split()[0] for x in AROUND.split(", ")])

    def sort(batches):
        held: list[dict] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK_ROWS:
                table = pa.Table.from_batches(held)
                key = table.column("hash").to_numpy()
                # The last anchor may go on in the next batch.
                cut = int(np.searchsorted(key, key[-1], "left"))
                if cut:
                    yield settled(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield settled(pa.Table.from_batches(held))

    found = near.mapInArrow(around, AROUND)
    return found.repartition("hash").sortWithinPartitions("hash", "none", "doc", "node", "place").mapInArrow(sort, RANGE)


def settled(table: pa.Table) -> pa.RecordBatch:
    """The ranges of whole groups of anchors, which come by hash and, within, in document order."""
    before, behind = repeats(table.column("before").to_pylist(), table.column("behind").to_pylist())
    hit = behind > 0
    place = table.column("place").to_numpy()[hit]
    return pa.RecordBatch.from_arrays([pa.array(table.column("node").to_numpy()[hit]), pa.array(place - before[hit]),
                                       pa.array(place + behind[hit])], names=["node", "start", "end"])


def hot_ranges(near: DataFrame) -> DataFrame:
    """Ranges of the anchors with very many places, by hashes of their strings."""

    def strings(batches):
        for batch in batches:
            rows, starts, one, two = [], [], [], []
            for row, text, at, _ in surroundings(batch, True):
                low, high = max(0, at - REACH), min(len(text), at + SPAN)
                data = np.frombuffer(text, np.uint8)[low:high]
                if len(data) < SPAN:
                    continue
                a, b = gram_hashes(data, SPAN), gram_hashes(data ^ np.uint8(0x5A), SPAN)
                rows += [row] * len(a)
                starts += range(low, low + len(a))
                one.append(a)
                two.append(b)
            take = pa.array(rows, pa.int64())
            key = [np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (one, two)]
            yield pa.RecordBatch.from_arrays([pa.array(key[0]), pa.array(key[1]), *[batch.column(n).take(take) for n in ("node", "none", "doc")],
                                              pa.array(starts, pa.int64())], names=["a", "b", "node", "none", "doc", "start"])

    found = near.where(F.exists("places", lambda p: p["hot"])).mapInArrow(
        strings, "a long, b long, node long, none boolean, doc long, start long")
    first = found.groupBy("a", "b").agg(F.min(F.struct("none", "doc", "node", "start")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    side = first.select("a", "b", F.col("f.node").alias("_node"), F.col("f.start").alias("_start"))
    both = found.join(splittable(side, "a", "b"), ["a", "b"]).where((F.col("node") != F.col("_node")) | (F.col("start") != F.col("_start")))
    return both.select("node", "start", (F.col("start") + SPAN).alias("end"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted(spans, key=lambda s: s["start"]):
        if out and s["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["end"])
        else:
            out.append([s["start"], s["end"]])
    return [(a, b) for a, b in out]


def dedup(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256 and the removed ranges as ``spans``."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranges = c.materialised(removed_ranges(docs, hot).groupBy("node").agg(F.collect_list(F.struct("start", "end")).alias("ranges")), "ranges", narrow=True)
    wanted = ranges.select("node")
    result = ("node long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches):
        for batch in batches:
            removed, count, digest, spans = [], [], [], []
            for text, own in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("ranges").to_pylist()):
                gone = merged(own)
                at, h = 0, hashlib.sha256()
                for a, b in gone:
                    h.update(text[at:a])
                    at = b
                h.update(text[at:])
                removed.append(sum(b - a for a, b in gone))
                count.append(len(gone))
                digest.append(h.hexdigest())
                spans.append([{"start": a, "end": b} for a, b in gone])
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest),
                                              pa.array(spans, span)], names=["node", "n_removed", "n_spans", "kept_sha256", "spans"])

    hit = firsts(docs).join(c.slim(wanted, wanted.count()), "node", "left_semi").select("node", "text")
    changed = c.materialised(hit.join(ranges, "node").mapInArrow(cut, result).dropDuplicates(["node"]), "cut", narrow=True)
    own = docs.select("doc_id", F.xxhash64("text").alias("node"), F.octet_length("text").cast("long").alias("n_bytes"),
                      F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
    many = copies(docs)
    own = own.join(c.slim(many, many.count()), "node", "left").join(splittable(changed, "node"), "node", "left")
    copy = F.coalesce(F.col("copied"), F.lit(False)) & ~F.col("doc_id").eqNullSafe(F.col("first"))
    every = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return own.select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        F.when(copy, every).otherwise(F.coalesce("spans", none)).alias("spans"))
