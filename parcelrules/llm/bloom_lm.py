"""Scoring texts by a bigram model whose counts lie in a log-frequency Bloom filter.

Counts c of words and word pairs are kept as levels q = 1 + floor(log2 c). An
n-gram with level q is entered q times, as (n-gram, 1) ... (n-gram, q); a look-up
probes (n-gram, 1), (n-gram, 2), ... until a probe fails, and the last level
that was found stands for the middle of its range of counts. An error can only
raise a count, and each further level needs another false hit, so gross errors
are exponentially rare.

Every n-gram of every level is entered. A filter has ``filter_bits`` at most;
a corpus with more entries than that holds at ``BITS_PER_ENTRY`` has more filters,
and the hash of an n-gram says which one is its own. All are broadcast, but a
worker holds one at a time: texts are gathered into lots, and each filter is
loaded once a lot and asked for its own n-grams. The texts are read once, however
many filters there are. The probability of a word w after v is

    P(w | v) = lambda * min(c(vw) / c(v), 1) + (1 - lambda) * (c(w) + 1) / (N + V + 1)

with lambda = ``WEIGHT`` where v was seen and 0 elsewhere. A text ends with one
end token, and starts after one.

Beside the model, ``score_documents`` gives the exact add-one unigram figures:
the ``FREQUENT`` commonest words are looked up in a broadcast table of that fixed
size, the rest by a join on the word.

Defined cases: a null or empty text is its end token; a null doc_id counts as
the empty text in the training split; repeated rows are trained on and scored
each; with no training token N = V = 0 and every word is unseen; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from parcelrules.llm import common as c

FILTER_BITS = 1 << 28        # 32 MB, of each filter
BITS_PER_ENTRY = 8
PROBES = 3
FREQUENT = 1 << 18           # words whose exact counts are broadcast: 4 MB
WEIGHT = 0.4
LEVELS = 64
CHUNK_WORDS = 1 << 13        # filter words (64 bits each) a row of the built filter holds
ENTER_KEYS = 1 << 17         # keys whose bits a task gathers per chunk at once
LOT_TOKENS = 1 << 22         # tokens that wait for a filter at once, if there are several
PART = np.uint64(0xD6E8FEB86659FD93)
END = np.uint64(0xE5D0E5D0E5D0E5D1)
PAIR = 2


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def tokens(column: pa.Array):
    """Per block of texts: row range, token hashes (an end token after each text) and each row's first token."""
    raw, offsets = c.text_bytes(column)
    for low, high in c.slices(offsets):
        data = c.ASCII_LOWER[raw[offsets[low]:offsets[high]]]
        starts, ends, first = c.word_bounds(data, offsets[low:high + 1] - offsets[low], c.SPACE)
        words = np.insert(c.range_hashes(data, starts, ends), first[1:], END)
        yield low, high, words, first + np.arange(high - low + 1)


def pair_hashes(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each token, the hash of the token before it (the end token before a text) with it."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[first[:-1]] = END
    return c.mix(before * c.BASE + words + np.uint64(PAIR))


def ngram_counts(texts: DataFrame, pairs: bool) -> DataFrame:
    """(key long, count long) of all words, or of all word pairs."""

    def count(batches):
        held, size = [], 0

        def out():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "count"])

        for batch in batches:
            for _, _, words, first in tokens(batch.column("text")):
                held.append(pair_hashes(words, first) if pairs else words)
                size += len(words)
                if size >= 1 << 22:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    found = texts.select("text").mapInArrow(count, "key long, count long")
    return found.groupBy("key").agg(F.sum("count").alias("count"))


def level(count: Column) -> Column:
    """1 + floor(log2 count), exactly."""
    return F.length(F.bin(count)).cast("int")


# --- the filter -------------------------------------------------------------------

def positions(keys: np.ndarray, at: int, probe: int, bits: int) -> np.ndarray:
    """The bit that entry (key, level ``at``) has for one of its probes."""
    seed = np.uint64(0xA24BAED4963EE407 * (at * PROBES + probe + 1) % (1 << 64))
    return (c.mix(keys ^ seed) & np.uint64(bits - 1)).astype(np.int64)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` filters (a power of two) an n-gram belongs to; independent of its bits there."""
    return (c.mix(keys ^ PART) & np.uint64(parts - 1)).astype(np.int64)


class LevelFilter:
    """One filter: a bit array and the level of any n-gram by repeated probes."""

    def __init__(self, bits: np.ndarray):
        self.words, self.size = bits, len(bits) * 64

    def levels(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        left = np.arange(len(keys))
        for at in range(1, LEVELS + 1):
            for probe in range(PROBES):
                bit = positions(keys[left], at, probe, self.size)
                left = left[(self.words[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1]
            if not len(left):
                break
            out[left] = at
        return out


class LevelFilters:
    """All filters, broadcast one by one. With several, no more than one is in a worker's memory."""

    def __init__(self, parts: list[Broadcast]):
        self.parts = parts

    def levels(self, keys: np.ndarray) -> np.ndarray:
        if len(self.parts) == 1:
            return self.parts[0].value.levels(keys)
        out = np.zeros(len(keys), np.int64)
        part = part_of(keys, len(self.parts))
        for k, held in enumerate(self.parts):
            own = np.flatnonzero(part == k)
            if len(own):
                out[own] = held.value.levels(keys[own])
                if getattr(held, "_path", None):     # the file stays, and is loaded again for the next lot
                    vars(held).pop("_value", None)
        return out

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The middle of the range of counts that a level stands for."""
        q = self.levels(keys).astype(np.float64)
        return np.where(q > 0, (3 * 2.0 ** (q - 1) - 1) / 2, 0.0)


def filter_shape(counts: DataFrame, most: int, one: bool = False) -> tuple[int, int]:
    """The number of filters and the bits of each, powers of two, for all entries; ``most`` bits each at most."""
    entries = counts.agg(F.sum(level(F.col("count"))).alias("n")).collect()[0]["n"] or 0
    parts, bits = 1, 64 * CHUNK_WORDS
    while not one and parts * most < entries * BITS_PER_ENTRY:
        parts *= 2
    while bits < min(most, -(-entries * BITS_PER_ENTRY // parts)):
        bits *= 2
    return parts, bits


def build_filters(counts: DataFrame, most_bits: int = FILTER_BITS, one: bool = False) -> Iterator[LevelFilter]:
    """The filters of (key, count) rows, built in pieces by the executors; the driver gets one after another.

    ``one``: all keys go into one filter, however full it gets.
    """
    parts, bits = filter_shape(counts, most_bits, one)
    chunk_bits = 64 * CHUNK_WORDS
    chunks = bits // chunk_bits      # of one filter

    def entered(keys: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        """The bits of some keys, gathered per chunk of the filters."""
        part, own_bits = part_of(keys, parts) * bits, []
        for at in range(1, int(q.max(initial=0)) + 1):
            own = q >= at
            own_bits += [part[own] + positions(keys[own], at, probe, bits) for probe in range(PROBES)]
        bit = np.unique(np.concatenate(own_bits)) if own_bits else np.zeros(0, np.int64)
        chunk, start = np.unique(bit // chunk_bits, return_index=True)
        rows = [x.astype("<u4").tobytes() for x in np.split(bit % chunk_bits, start[1:])] if len(chunk) else []
        return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(rows, pa.binary())], names=["chunk", "bits"])

    def pieces(batches):
        held, size = [], 0
        for batch in batches:
            held.append((batch.column("key").to_numpy().view(np.uint64), batch.column("q").to_numpy().astype(np.int64)))
            size += batch.num_rows
            if size >= ENTER_KEYS:
                yield entered(*map(np.concatenate, zip(*held)))
                held, size = [], 0
        if held:
            yield entered(*map(np.concatenate, zip(*held)))

    def merged(rows: pa.Table) -> pa.Table:
        """One chunk; its entries are bounded, as all entries fit the filters."""
        words = np.zeros(CHUNK_WORDS, np.uint64)
        for raw in rows.column("bits").to_pylist():
            bit = np.frombuffer(raw, "<u4").astype(np.int64)
            np.bitwise_or.at(words, bit >> 6, np.uint64(1) << (bit & 63).astype(np.uint64))
        return pa.table({"chunk": rows.column("chunk").slice(0, 1), "words": pa.array([words.tobytes()], pa.binary())})

    built = counts.select("key", level(F.col("count")).alias("q")).mapInArrow(pieces, "chunk long, bits binary").groupBy(
        "chunk").applyInArrow(merged, "chunk long, words binary")
    if parts > 1:
        built = c.materialised(built, "lm-filters").orderBy("chunk")     # one filter's chunks after another's
    out, part = np.zeros(bits // 64, np.uint64), 0
    for row in built.toLocalIterator():
        while part < row["chunk"] // chunks:
            yield LevelFilter(out)
            out, part = np.zeros(bits // 64, np.uint64), part + 1
        at = row["chunk"] % chunks * CHUNK_WORDS
        out[at:at + CHUNK_WORDS] = np.frombuffer(row["words"], np.uint64)
    while part < parts:
        yield LevelFilter(out)
        out, part = np.zeros(bits // 64, np.uint64), part + 1


def build_filter(counts: DataFrame, most_bits: int = FILTER_BITS, every: bool = True) -> LevelFilter:
    """One filter with all keys; its size bounds what the driver gets."""
    return next(build_filters(counts, most_bits, one=every))


# --- the model ----------------------------------------------------------------------

class Model:
    """Word counts written to the shared folder, their totals, and the filter."""

    def __init__(self, texts: DataFrame, filter_bits: int = FILTER_BITS):
        self.spark: SparkSession = texts.sparkSession
        self.word_counts = c.materialised(ngram_counts(texts, False), "lm-words")
        both = self.word_counts.unionByName(ngram_counts(texts, True))
        both = c.materialised(both, "lm-ngrams")
        totals = self.word_counts.agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("v")).collect()[0]
        self.tokens, self.types = totals["n"] or 0, totals["v"]
        self.filters = LevelFilters([self.spark.sparkContext.broadcast(f) for f in build_filters(both, filter_bits)])

    def log_probabilities(self, blocks: list[tuple[np.ndarray, np.ndarray]], filters: LevelFilters) -> Iterator[np.ndarray]:
        """Per block (its tokens, its rows' first ones) log10 P of each token after the one before it."""
        asked, places = [np.array([END])], []
        for words, first in blocks:
            distinct, inverse = np.unique(words, return_inverse=True)
            asked += [distinct, pair_hashes(words, first)]
            places.append(inverse.astype(np.int32))
        sizes = [len(x) for x in asked]
        counts = np.split(filters.counts(np.concatenate(asked)), np.cumsum(sizes)[:-1])
        at_end = counts[0][0]
        for k, (words, first) in enumerate(blocks):
            own, pair = counts[2 * k + 1][places[k]], counts[2 * k + 2]
            before = np.empty_like(own)
            before[1:] = own[:-1]
            before[first[:-1]] = at_end
            single = np.minimum((own + 1) / (self.tokens + self.types + 1), 1.0)
            weight = np.where(before > 0, WEIGHT, 0.0)
            after = np.minimum(np.divide(pair, before, out=np.zeros_like(pair), where=before > 0), 1.0)
            yield np.log10(weight * after + (1 - weight) * single)


def score_documents(docs: DataFrame, training: DataFrame, filter_bits: int = FILTER_BITS,
                    frequent: int = FREQUENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, perhaps held_out): n_tokens, n_known, train_tokens, base_score and score.

    The texts are read once. Words outside the broadcast table go, counted per
    text, to a join with their exact counts; what they add comes back by row.
    """
    spark = docs.sparkSession
    model = Model(training, filter_bits)
    top = model.word_counts.orderBy(F.desc("count"), "key").limit(frequent).toArrow()
    keys = top.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    known = spark.sparkContext.broadcast((keys[order], top.column("count").to_numpy()[order]))
    filters = model.filters
    lot_tokens = LOT_TOKENS if len(filters.parts) > 1 else 0
    n, v = model.tokens, model.types
    plain = _Totals(n, v)
    carried = [x for x in ("doc_id", "held_out") if x in docs.columns]
    schema = docs.select(*carried).schema.add("row", "long").add("n_tokens", "long").add("known", "long").add(
        "base", "double").add("score", "double").add("rare", T.ArrayType(T.StructType().add("key", "long").add("n", "integer")))

    def lots(batches):
        """Blocks of one lot after another: the carried columns of a block's rows, its tokens, the rows' first ones."""
        lot, size = [], 0
        for batch in batches:
            for low, high, words, first in tokens(batch.column("text")):
                lot.append(([batch.column(x).slice(low, high - low) for x in carried], words, first))
                size += len(words)
                if size >= lot_tokens:
                    yield lot
                    lot, size = [], 0
        if lot:
            yield lot

    def score(batches):
        task, at = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40, 0
        common_keys, common_counts = known.value
        for lot in lots(batches):
            chances = plain.log_probabilities([(words, first) for _, words, first in lot], filters)
            for (own, words, first), chance in zip(lot, chances):
                rows = len(first) - 1
                row = np.repeat(np.arange(rows), np.diff(first))
                place = np.searchsorted(common_keys, words)
                place[place == len(common_keys)] = 0
                hit = common_keys[place] == words if len(common_keys) else np.zeros(len(words), bool)
                base = np.bincount(row[hit], np.log10((common_counts[place[hit]] + 1) / (n + v + 1)), rows).astype(np.float64)
                rare_rows: list[list] = [[] for _ in range(rows)]
                rare = ~hit
                if rare.any():
                    sort = np.lexsort((words[rare], row[rare]))
                    key, owner = words[rare][sort], row[rare][sort]
                    begin = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])))
                    many = np.diff(np.append(begin, len(key)))
                    for k, o, m in zip(key[begin].view(np.int64).tolist(), owner[begin].tolist(), many.tolist()):
                        rare_rows[o].append({"key": k, "n": m})
                arrays = own + [
                    pa.array(task + at + np.arange(rows)), pa.array(np.diff(first)), pa.array(np.bincount(row[hit], minlength=rows)),
                    pa.array(base), pa.array(np.bincount(row, chance, rows).astype(np.float64)),
                    pa.array(rare_rows, pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int32())])))]
                at += rows
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    # Written once, so the row numbers of both uses below are the same ones.
    scored = c.materialised(docs.mapInArrow(score, schema), "lm-scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.key", "r.n")
    found = rare.join(model.word_counts, "key", "left").groupBy("row").agg(
        F.sum(F.when(F.col("count").isNotNull(), F.col("n")).otherwise(0)).alias("more"),
        F.sum(F.col("n") * F.log10((F.coalesce("count", F.lit(0)) + 1) / F.lit(float(n + v + 1)))).alias("rest"))
    return scored.join(found, "row", "left").select(
        *carried, "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        "score")


class _Totals(Model):
    """A model's totals without its tables, to send to the workers."""

    def __init__(self, tokens_: int, types_: int):
        self.tokens, self.types = tokens_, types_


def score_table(documents: DataFrame) -> DataFrame:
    """Every document scored by the model of those outside the held-out seventh."""
    docs = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    out = score_documents(docs, docs.where(~F.col("held_out")))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
