"""Removal of repeated word windows, by compacting the de Bruijn graph of repeated token k-mers.

A word goes if a window of ``WINDOW`` words that covers it also starts anywhere else.
The graph's edges are the ``WINDOW``-word k-mers; a document is a walk over its edges.

1. Super-k-mers. Each window has a minimizer, the least hash of its ``GRAM``-word runs (of
   equal ones the first). Neighbouring windows with one minimizer at one place form a stretch, so
   equal windows lie in stretches with equal minimizers. A first scan counts the stretches of each minimizer
   and whether all are alike.
2. Edges. A second scan skips minimizers that occur once, and names every other stretch by a 128-bit BLAKE2
   digest of its words. Equal stretches are counted and stand for each other from here on, with the
   coordinates of their first occurrence, the source. Where all of a minimizer's stretches are alike, a
   stretch is a path without branches and becomes one edge. Else the windows of each distinct
   stretch are read at its source, each an edge with a digest and a source of its own. Edges with two
   occurrences are the repeated graph.
3. Compaction. Stretches and their order in documents link neighbouring edges. A link is kept if it
   is the only one out of its edge and the only one into the next. Links between neighbours in the
   source are folded by a window over source coordinates; the rest by joins that double pointers.
4. Spans. A path's edges in a document make its repeated spans. An occurrence's words agree with
   those at the source coordinates, as their digests do.

The two filters of minimizers have a fixed size (``FILTER_BITS`` each) and are broadcast; a full one lets more
through, which counting then sorts out, so results don't depend on it. Words are told apart by 64-bit
hashes only for choosing minimizers and for seeing that two stretches of one minimizer differ (two
that do would have to share a hash, a chance of 2 ** -64 a pair).

Defined cases: a null text is empty and has no words; a null doc_id is kept as it is; each row is a
document of its own, so repeated rows are copies of each other; extra columns are not read; an empty table gives
no rows. A text is hashed in pieces, a very long word by a digest of its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from parcelrules.llm import common as c
from parcelrules.operators.skew import splittable

WINDOW = 35
GRAM = 16
CHOICE = WINDOW - GRAM + 1        # runs in a window
FILTER_BITS = 27                  # 16 MB a filter
PLACE_BITS = np.uint64(20)        # a piece has fewer words
SLICE_BYTES = 1 << 19
PIECE = 1 << 17                   # windows of a text looked at together
BLANKS = bytes(0x20 if b == 0x20 or 0x09 <= b <= 0x0D else b for b in range(256))
STRETCH = "one long, two long, next_one long, next_two long, row long, start int, n int, several boolean"
IN_STRETCH = "cr long, cs int, offset int, w1 long, w2 long, times long"


# --- words and stretches ----------------------------------------------------------------

def plain(text: bytes) -> bytes:
    """The words joined by one space."""
    text = text.translate(BLANKS)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text.strip(b" ")


class Words:
    """The words of some texts, one after the other."""

    def __init__(self, texts: list[bytes]):
        self.data = b" ".join(t for t in texts if t)
        raw = np.frombuffer(self.data, np.uint8)
        blanks = np.flatnonzero(raw == 0x20)
        self.starts, self.ends = np.append(0, blanks + 1), np.append(blanks, len(raw))
        if not self.data:
            self.starts, self.ends = self.starts[:0], self.ends[:0]
        self.first = np.append(0, np.cumsum([t.count(b" ") + 1 if t else 0 for t in texts]))     # each text's first word

    def hashes(self) -> np.ndarray:
        return c.range_hashes(np.frombuffer(self.data, np.uint8), self.starts, self.ends)

    def text(self, low: int, high: int) -> bytes:
        return self.data[self.starts[low]:self.ends[high - 1]]


def slices_of(column: pa.Array):
    """(first row, Words) of about SLICE_BYTES, one text at least."""
    held, first, size = [], 0, 0
    for row, text in enumerate(column.cast(pa.large_binary())):
        text = plain(text.as_py() or b"")
        if held and size + len(text) > SLICE_BYTES:
            yield first, Words(held)
            held, first, size = [], row, 0
        held.append(text)
        size += len(text)
    if held:
        yield first, Words(held)


def stretches(hashes: np.ndarray, first: np.ndarray):
    """Per piece: start word and windows of each stretch, its minimizer, and a hash of its words."""
    for low in range(0, max(len(hashes) - WINDOW + 1, 0), PIECE):
        words = hashes[low:low + PIECE + WINDOW - 1]
        up, down = c.powers(len(words) + 1)
        sums = np.append(np.uint64(0), np.cumsum(words * up[:len(words)], dtype=np.uint64))
        grams = c.mix((sums[GRAM:] - sums[:-GRAM]) * down[:len(sums) - GRAM])
        key = (grams >> PLACE_BITS << PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
        width, least = 1, key
        while 2 * width <= CHOICE:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = CHOICE - width
        least = np.minimum(least[:len(least) - rest], least[rest:])
        start = np.arange(len(least))
        text = np.searchsorted(first, start + low, "right") - 1
        start = start[start + low + WINDOW <= first[text + 1]]
        place = (least[start] & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
        if not len(start):
            continue
        fresh = np.append(True, (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1))
        begin = start[fresh]
        n = np.diff(np.append(np.flatnonzero(fresh), len(start)))
        whole = c.mix((sums[begin + n + WINDOW - 1] - sums[begin]) * down[begin] + n.astype(np.uint64))
        yield begin + low, n, grams[place[fresh]], whole


def minimizers(texts: DataFrame) -> DataFrame:
    """(minimizer, several) of those that occur more than once; several: not all stretches are alike."""

    def run(batches):
        for batch in batches:
            for _, words in slices_of(batch.column("text")):
                for _, _, least, whole in stretches(words.hashes(), words.first):
                    yield pa.RecordBatch.from_arrays([pa.array(least.view(np.int64)), pa.array(whole.view(np.int64))], names=["minimizer", "whole"])

    found = texts.select("text").mapInArrow(run, "minimizer long, whole long")
    return found.groupBy("minimizer").agg(F.count(F.lit(1)).alias("n"), F.min("whole").alias("low"), F.max("whole").alias("high")) \
        .where("n > 1").select("minimizer", (F.col("low") != F.col("high")).alias("several"))


# --- filters ------------------------------------------------------------------------------

def filters(found: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Two bit tables over the top bits of minimizers, by 64-bit block: any, and several."""
    place = F.shiftrightunsigned("minimizer", 64 - bits)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(minimizer, {64 - bits}) & 63 as int))")
    blocks = found.groupBy(F.shiftright(place, 6).alias("block")).agg(
        F.bit_or(bit).alias("any"), F.bit_or(F.when(F.col("several"), bit).otherwise(F.lit(0).cast("long"))).alias("several"))
    table = blocks.toArrow()                                # at most 2 ** (bits - 6) rows
    out = np.zeros((2, 1 << bits - 6), np.uint64)
    out[:, table.column("block").to_numpy()] = [table.column(n).to_numpy().view(np.uint64) for n in ("any", "several")]
    return out


def passes(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys >> np.uint64(64 - (len(table).bit_length() - 1 + 6))
    return (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


# --- stretches and edges ----------------------------------------------------------------------

def digest(words: Words, low: int, high: int) -> bytes:
    return hashlib.blake2b(words.text(low, high), digest_size=16).digest()


def halves(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(digests), "<i8")
    return pa.array(both[0::2]), pa.array(both[1::2])


def occurrences(texts: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Every stretch that may repeat: digest, the next one's if it follows at once, row, first word, windows, and ``several``."""
    known = texts.sparkSession.sparkContext.broadcast(filters(c.materialised(minimizers(texts), "minimizers", narrow=True), bits))

    def run(batches):
        for batch in batches:
            rows = batch.column("row").to_numpy()
            for low, words in slices_of(batch.column("text")):
                for begin, n, least, _ in stretches(words.hashes(), words.first):
                    may = passes(known.value[0], least)
                    begin, n, least = begin[may], n[may], least[may]
                    one, two = halves([digest(words, a, a + m + WINDOW - 1) for a, m in zip(begin.tolist(), n.tolist())])
                    text = np.searchsorted(words.first, begin, "right") - 1
                    then = np.append(np.arange(1, len(begin)), 0)[:len(begin)]
                    apart = np.append(begin[1:] != begin[:-1] + n[:-1], True)[:len(begin)]
                    yield pa.RecordBatch.from_arrays(
                        [one, two, *(pa.array(x.to_numpy()[then], mask=apart) for x in (one, two)), pa.array(rows[low + text]),
                         pa.array((begin - words.first[text]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(passes(known.value[1], least))],
                        names=[x.split()[0] for x in STRETCH.split(", ")])

    return c.materialised(texts.mapInArrow(run, STRETCH), "stretches")


def distinct_stretches(found: DataFrame) -> DataFrame:
    """Each stretch once: its source coordinates, and how often it occurs; those that can hold no repeat are left out."""
    return c.materialised(found.groupBy("one", "two").agg(
        F.min(F.struct("row", "start")).alias("source"), F.min("n").alias("size"), F.max("several").alias("several"), F.count(F.lit(1)).alias("times"))
        .where("several OR times > 1").select("one", "two", F.col("source.row").alias("cr"), F.col("source.start").alias("cs"), "size", "several", "times"),
        "distinct-stretches", narrow=True)


def windows(texts: DataFrame, distinct: DataFrame) -> DataFrame:
    """The windows of stretches whose minimizer has several, read at the source: source coordinates, offset, digest, times."""
    wanted = distinct.where("several").groupBy(F.col("cr").alias("row")).agg(F.collect_list(F.struct("cs", "size", "times")).alias("own"))

    def run(batches):
        for batch in batches:
            for row, text, own in zip(batch.column("row").to_pylist(), batch.column("text").cast(pa.large_binary()), batch.column("own").to_pylist()):
                words = Words([plain(text.as_py() or b"")])
                own.sort(key=lambda x: x["cs"])
                size = np.array([x["size"] for x in own])
                start = np.array([x["cs"] for x in own]).repeat(size)
                offset = np.arange(size.sum()) - (np.cumsum(size) - size).repeat(size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(start), row)), pa.array(start.astype(np.int32)), pa.array(offset.astype(np.int32)),
                     *halves([digest(words, a, a + WINDOW) for a in (start + offset).tolist()]),
                     pa.array(np.array([x["times"] for x in own], np.int64).repeat(size))], names=[x.split()[0] for x in IN_STRETCH.split(", ")])

    return c.materialised(texts.join(wanted, "row").select("row", "text", "own").mapInArrow(run, IN_STRETCH), "windows")


def edges(texts: DataFrame, distinct: DataFrame) -> DataFrame:
    """The repeated edges in each distinct stretch (cr, cs): offset, windows, and the edge's source coordinates er, es."""
    inside = windows(texts, distinct)
    again = inside.groupBy("w1", "w2").agg(F.sum("times").alias("times"), F.min(F.struct("cr", F.col("cs") + F.col("offset"))).alias("source")) \
        .where("times > 1").select("w1", "w2", F.col("source.cr").alias("er"), F.col("source.col2").alias("es"))
    single = inside.join(splittable(again, "w1", "w2"), ["w1", "w2"]).select("cr", "cs", "offset", F.lit(1).alias("n"), "er", "es")
    whole = distinct.where("NOT several").select("cr", "cs", F.lit(0).alias("offset"), F.col("size").alias("n"), F.col("cr").alias("er"), F.col("cs").alias("es"))
    made = c.materialised(single.unionByName(whole), "edges", narrow=True)
    c.removed(inside)
    return made


# --- compaction -------------------------------------------------------------------------------

def links(found: DataFrame, distinct: DataFrame, own: DataFrame) -> DataFrame:
    """Distinct (er, es, n, nr, ns): an edge, and one that follows it at once in some document."""
    walk = Window.partitionBy("cr", "cs").orderBy("offset")
    follows = F.lead("offset").over(walk) == F.col("offset") + F.col("n")
    inner = own.select("er", "es", "n", F.when(follows, F.lead("er").over(walk)).alias("nr"), F.when(follows, F.lead("es").over(walk)).alias("ns")).where("nr IS NOT NULL")
    pairs = found.where("next_one IS NOT NULL").select("one", "two", "next_one", "next_two").distinct()
    named = own.join(distinct.select("one", "two", "cr", "cs", "size"), ["cr", "cs"])
    last = named.where("offset + n = size").select("one", "two", "er", "es", "n")
    first = named.where("offset = 0").select(F.col("one").alias("next_one"), F.col("two").alias("next_two"), F.col("er").alias("nr"), F.col("es").alias("ns"))
    across = pairs.join(last, ["one", "two"]).join(first, ["next_one", "next_two"]).select("er", "es", "n", "nr", "ns")
    return c.materialised(inner.unionByName(across).where("nr <> er OR ns <> es").distinct(), "links", narrow=True)


def single_links(pairs: DataFrame) -> DataFrame:
    """The only link out of an edge, if it is the only one into the next."""
    for own in (["er", "es"], ["nr", "ns"]):
        once = pairs.groupBy(*own).agg(F.count(F.lit(1)).alias("ways")).where("ways = 1").drop("ways")
        pairs = pairs.join(splittable(once, *own), own)
    return c.materialised(pairs, "single-links", narrow=True)


def path_heads(own: DataFrame, single: DataFrame) -> DataFrame:
    """(er, es, pr, ps): the first edge of each edge's path; in a circle, the one of least coordinates."""
    straight = (F.col("nr") == F.col("er")) & (F.col("ns") == F.col("es") + F.col("n"))
    follows = single.where(straight).select(F.col("nr").alias("er"), F.col("ns").alias("es"), F.lit(True).alias("goes_on"))
    along = Window.partitionBy("er").orderBy("es").rowsBetween(Window.unboundedPreceding, 0)
    parts = c.materialised(own.select("er", "es").distinct().join(follows, ["er", "es"], "left").select(
        "er", "es", F.max(F.when(F.col("goes_on").isNull(), F.col("es"))).over(along).alias("head")), "path-parts", narrow=True)
    jumps = single.where(~straight).join(parts, ["er", "es"]).select("nr", "ns", F.col("er").alias("pr"), F.col("head").alias("ps"))
    heads = followed(jumps)
    if heads is None:
        return parts.select("er", "es", F.col("er").alias("pr"), F.col("head").alias("ps"))
    near = heads.select(F.col("nr").alias("er"), F.col("ns").alias("head"), "pr", "ps")
    return parts.join(splittable(near, "er", "head"), ["er", "head"], "left").select(
        "er", "es", F.coalesce("pr", "er").alias("pr"), F.coalesce("ps", "head").alias("ps"))


def followed(jumps: DataFrame) -> DataFrame | None:
    """Each part's first ancestor (pr, ps), by pointers that double; None if there are no jumps."""
    now = c.materialised(jumps.withColumn("least", F.least(F.struct(F.col("nr").alias("r"), F.col("ns").alias("s")),
                                                           F.struct(F.col("pr").alias("r"), F.col("ps").alias("s")))), "jumps", narrow=True)
    n = now.count()
    if not n:
        return None
    for _ in range(n.bit_length() + 1):
        up = now.select(F.col("nr").alias("pr"), F.col("ns").alias("ps"), F.col("pr").alias("ur"), F.col("ps").alias("us"), F.col("least").alias("over"))
        now = c.materialised(now.join(up, ["pr", "ps"], "left").select(
            "nr", "ns", F.coalesce("ur", "pr").alias("pr"), F.coalesce("us", "ps").alias("ps"), F.least("least", "over").alias("least"),
            F.col("ur").isNotNull().alias("on")), "jumps", narrow=True)
        if not now.where("on").limit(1).count():
            return now
        now = now.drop("on")
    # What still moves runs in a circle, and has seen all of it by now.
    inside = now.select(F.col("nr").alias("pr"), F.col("ns").alias("ps"), F.lit(True).alias("circle"))
    return now.join(inside, ["pr", "ps"], "left").select(
        "nr", "ns", F.when(F.col("circle"), F.col("least.r")).otherwise(F.col("pr")).alias("pr"),
        F.when(F.col("circle"), F.col("least.s")).otherwise(F.col("ps")).alias("ps"))


def pieces(texts: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """(row, start, end, pr, ps): word ranges that a repeated path covers within one stretch; neighbours overlap."""
    found = occurrences(texts, bits)
    distinct = distinct_stretches(found)
    own = edges(texts, distinct)
    heads = path_heads(own, single_links(links(found, distinct, own)))
    walk = Window.partitionBy("cr", "cs").orderBy("offset")
    before = F.lag(F.struct(F.col("offset") + F.col("n"), "pr", "ps")).over(walk)
    runs = own.join(splittable(heads, "er", "es"), ["er", "es"]).withColumn("fresh", (~before.eqNullSafe(F.struct("offset", "pr", "ps"))).cast("int")) \
        .withColumn("run", F.sum("fresh").over(walk.rowsBetween(Window.unboundedPreceding, 0))).groupBy("cr", "cs", "run") \
        .agg(F.min("offset").alias("offset"), F.sum("n").cast("int").alias("n"), F.first("pr").alias("pr"), F.first("ps").alias("ps"))
    runs = runs.join(distinct.select("one", "two", "cr", "cs"), ["cr", "cs"])
    return found.select("one", "two", "row", "start").join(splittable(runs, "one", "two"), ["one", "two"]).select(
        "row", (F.col("start") + F.col("offset")).alias("start"), (F.col("start") + F.col("offset") + F.col("n") + (WINDOW - 1)).alias("end"), "pr", "ps")


def spans(found: DataFrame) -> DataFrame:
    """Pieces of one path that follow at once, as one range: (row, start, end, pr, ps)."""
    walk = Window.partitionBy("row").orderBy("start")
    before = F.lag(F.struct(F.col("end") - (WINDOW - 1), "pr", "ps")).over(walk)
    marked = found.withColumn("fresh", (~before.eqNullSafe(F.struct("start", "pr", "ps"))).cast("int"))
    return marked.withColumn("run", F.sum("fresh").over(walk.rowsBetween(Window.unboundedPreceding, 0))).groupBy("row", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.first("pr").alias("pr"), F.first("ps").alias("ps")).drop("run")


def numbered(docs: DataFrame) -> DataFrame:
    """row, doc_id and text, written once in buckets by row: a row's number stays, and joins on it leave the texts where they are."""
    return c.bucketed(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "row", "numbered")


def repeated_paths(docs: DataFrame) -> DataFrame:
    """The repeated paths' occurrences: doc_id, start and end word, path (source row and word), occurrences of the path."""
    texts = numbered(docs)
    found = c.materialised(spans(pieces(texts)), "spans", narrow=True)
    times = found.groupBy("pr", "ps").agg(F.count(F.lit(1)).alias("occurrences"))
    return found.join(splittable(times, "pr", "ps"), ["pr", "ps"]).join(texts.select("row", "doc_id"), "row").select(
        "doc_id", "start", "end", F.col("pr").alias("path_row"), F.col("ps").alias("path_start"), "occurrences")


def dedup(docs: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 and the number of its spans of repeated paths."""
    texts = numbered(docs)
    ranges = pieces(texts, bits).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))

    def cut(batches):
        for batch in batches:
            out = []
            for text, own in zip(batch.column("text").cast(pa.large_binary()), batch.column("ranges")):
                words = Words([plain(text.as_py() or b"")])
                n, at, gone, h, any_ = len(words.starts), 0, 0, hashlib.sha256(), False
                for a, b in [*sorted((r["start"], r["end"]) for r in own.as_py() or []), (n, n)]:
                    if a > at:
                        h.update(b" " * any_ + words.text(at, a))
                        any_ = True
                    gone += max(b - max(a, at), 0)
                    at = max(at, b)
                out.append((n, gone, h.hexdigest(), len(own) if own.is_valid else 0))
            n, gone, digest, count = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()),
                                              pa.array(count, pa.int64())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "n_spans"])

    kind = dict(docs.dtypes)["doc_id"]
    return texts.join(ranges, "row", "left").select("doc_id", "text", "ranges").mapInArrow(
        cut, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, n_spans long")
