"""Packing into fixed windows by order-preserving dynamic programming.

The documents of a Spark partition form one stream of token ids. A cut may lie
at the end of a document (free), at the end of a sentence (``SENTENCE`` points)
or, in stretches of more than ``LOOSE`` tokens without either, every ``STEP``
tokens (``INSIDE`` points). A window costs its padding, one point per token.
With cut positions b and cut points p, the least cost up to cut j is

    f(j) = min over i with b(j) - b(i) <= SIZE of  f(i) + b(i)  + SIZE - b(j) + p(j)

so the minimum slides over f(i) + b(i): a monotone queue gives every f in
constant time. The stream is solved in runs of about ``RUN`` tokens; a run's
last window is not settled but starts the next run, so only the last window of
a partition is padded for want of text.

Ids come from a public tokenizer whose pieces never span white space: the words
of a batch are told apart, each distinct one is encoded once, and its ids are
gathered. A worker remembers the words of earlier batches, up to ``REMEMBER``.

Defined cases: a null or empty text is a document of one id (the end mark);
repeated rows and ids are packed each on their own; a partition without rows
gives nothing; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from parcelrules.llm import common as c

SIZE = 4096
END_ID = 2
SENTENCE, INSIDE = 16, 128
LOOSE, STEP = 256, 64
RUN = 1 << 20
REMEMBER = 1 << 19          # words a task keeps, in about 30 MB
ENCODED = 1 << 12           # words encoded at once
SLICE = 1 << 19             # bytes of text encoded at once
PIECES = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
MARK = np.zeros(256, bool)       # ASCII signs that never share a piece with a letter; not the apostrophe
MARK[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
STOP = np.zeros(256, bool)
STOP[[ord(x) for x in ".!?"]] = True


class WordIds:
    """Token ids of words, each distinct word encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        # Sorted hashes and where each one's ids are told.
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.starts, self.counts = np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.pool, self.used = np.zeros(4096, np.uint32), 0

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in order, and the number of ids of each word."""
        distinct, first, inverse = np.unique(c.range_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > REMEMBER:
            self.forget()
        near = np.searchsorted(self.keys, distinct)
        hit = near < len(self.keys)
        hit[hit] = self.keys[near[hit]] == distinct[hit]
        at = np.full(len(distinct), -1, np.int64)
        at[hit] = self.places[near[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            words = [data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(starts[first[new]], ends[first[new]])]
            counts, parts = np.zeros(len(words), np.int64), []
            for at_word in range(0, len(words), ENCODED):      # the encoder's own results are large
                ids = [e.ids for e in self.tokenizer.encode_batch_fast(words[at_word:at_word + ENCODED], add_special_tokens=False)]
                counts[at_word:at_word + len(ids)] = [len(x) for x in ids]
                parts.append(np.array([i for x in ids for i in x], np.uint32))
            flat = np.concatenate(parts)
            known, total = len(self.keys), len(self.keys) + len(new)
            if total > len(self.starts):
                self.starts, self.counts = np.resize(self.starts, 2 * total), np.resize(self.counts, 2 * total)
            if self.used + len(flat) > len(self.pool):
                self.pool = np.resize(self.pool, 2 * (self.used + len(flat)))
            self.starts[known:total] = self.used + np.cumsum(counts) - counts
            self.counts[known:total] = counts
            self.pool[self.used:self.used + len(flat)] = flat
            self.used += len(flat)
            at[new] = np.arange(known, total)
            self.keys = np.insert(self.keys, near[new], distinct[new])
            self.places = np.insert(self.places, near[new], at[new].astype(np.int32))
        word = at[inverse]
        counts = self.counts[word].astype(np.int64)
        step = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        return self.pool[np.repeat(self.starts[word], counts) + step], counts


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and the starts, ends and first-of-row of stretches that are encoded alone.

    White space always parts pieces, and so does the border of an ASCII letter
    and an ASCII sign. A batch with the opening of a special token is only
    parted at white space and keeps its case.
    """
    special = b"<|" in data.tobytes()
    starts, ends, first = c.word_bounds(data, offsets, c.SPACE)
    if special or not len(data):
        return data, starts, ends, first
    letter, mark = LETTER[data], MARK[data]
    border = np.flatnonzero((letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])) + 1
    border = border[~np.isin(border, offsets)]
    starts, ends = np.sort(np.concatenate([starts, border])), np.sort(np.concatenate([ends, border]))
    return c.ASCII_LOWER[data], starts, ends, np.searchsorted(starts, offsets)


def encoded(column: pa.Array, words: WordIds) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text: its ids with the end mark, and the positions after which a sentence ends."""
    raw, offsets = c.text_bytes(column)
    for low, high in c.slices(offsets, SLICE):
        rows = offsets[low:high + 1] - offsets[low]
        data, starts, ends, first = units(raw[offsets[low]:offsets[high]], rows)
        ids, counts = words.encode(data, starts, ends) if len(starts) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        total = np.concatenate([[0], np.cumsum(counts)])
        stop = np.zeros(len(starts), bool)
        if len(starts):
            lines = np.concatenate([[0], np.cumsum(data == 10)])
            after = np.append(starts[1:], len(data))
            space = np.append(c.SPACE[data], True)
            stop = (STOP[data[ends - 1]] & space[ends]) | (lines[after] > lines[ends])
        for row in range(high - low):
            a, b = first[row], first[row + 1]
            own = total[a + 1:b + 1][stop[a:b]] - total[a]
            yield np.append(ids[total[a]:total[b]], np.uint32(END_ID)), own


def cuts(total: int, free: list[int], sentence: np.ndarray, size: int = SIZE) -> list[int]:
    """The chosen cut positions, 0 first and ``total`` last."""
    points = dict.fromkeys(sentence.tolist(), SENTENCE) | dict.fromkeys(free, 0)
    points.pop(0, None)
    points[total] = 0
    places = sorted(points)
    step, loose = min(STEP, size), min(LOOSE, size)
    before = 0
    for at in places:
        if at - before > loose:
            points.update(dict.fromkeys(range(before + step, at, step), INSIDE))
        before = at
    b = [0, *sorted(points)]
    g, origin, queue, head = [0] * len(b), [0] * len(b), [0], 0
    for j in range(1, len(b)):
        low = b[j] - size
        while b[queue[head]] < low:
            head += 1
        i = queue[head]
        origin[j] = i
        g[j] = value = g[i] + size + points[b[j]]
        while len(queue) > head and g[queue[-1]] > value:
            queue.pop()
        queue.append(j)
    out, j = [total], len(b) - 1
    while j:
        j = origin[j]
        out.append(b[j])
    return out[::-1]


class Stream:
    """Documents not yet packed: (doc_id, ids, done), where the first ``done`` ids are in earlier windows."""

    def __init__(self, task: int, size: int):
        self.docs: list[tuple] = []
        self.stops: list[np.ndarray] = []
        self.total, self.size, self.next_window = 0, size, task << 32

    def add(self, doc_id, ids: np.ndarray, stops: np.ndarray) -> None:
        self.docs.append((doc_id, ids, 0))
        self.stops.append(stops + self.total)
        self.total += len(ids)

    def settle(self, last: bool) -> Iterator[tuple]:
        """Pieces of the run's windows; of the last window only at the end."""
        if not self.docs:
            return
        lengths = [len(ids) - done for _, ids, done in self.docs]
        ends = np.cumsum(lengths).tolist()
        stops = np.concatenate(self.stops)
        chosen = cuts(self.total, ends, stops, self.size)
        if not last:
            chosen = chosen[:-1]
        k, begin = 0, 0
        for low, high in zip(chosen, chosen[1:]):
            at = low
            while at < high:
                doc_id, ids, done = self.docs[k]
                start = done + at - begin
                take = min(high, ends[k]) - at
                yield doc_id, start, take, ids[start:start + take].tobytes(), len(ids), self.next_window, at - low
                at += take
                if at == ends[k]:
                    k, begin = k + 1, ends[k]
            self.next_window += 1
        open_at = chosen[-1]
        rest = self.docs[k:]
        if rest and open_at > begin:
            doc_id, ids, done = rest[0]
            rest[0] = (doc_id, ids, done + open_at - begin)
        self.docs, self.stops = rest, [stops[stops > open_at] - open_at]
        self.total -= open_at


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE, run: int = RUN) -> DataFrame:
    """Pieces of the windows: which ids of which document lie where.

    ``ids`` holds them as little-endian 32-bit numbers. Nothing is shuffled; a
    task holds one run of ids, or one document where that is longer.
    """

    def solve(batches):
        words = encoder(tokenizer_path)
        context = TaskContext.get()
        stream = Stream(context.partitionId() if context else 0, size)
        try:
            for batch in batches:
                out = []
                for doc_id, (ids, stops) in zip(batch.column("doc_id").to_pylist(), encoded(batch.column("text"), words)):
                    stream.add(doc_id, ids, stops)
                    if stream.total >= run:
                        out.extend(stream.settle(False))
                yield frame(out)
            yield frame(list(stream.settle(True)))
        finally:
            words.forget()      # a worker lives on after its task

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(solve, PIECES)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def frame(pieces: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*pieces)) or [[]] * len(SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, SCHEMA)], schema=SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")
