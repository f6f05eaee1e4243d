"""Benchmark decontamination: Wu-Manber search for windows of benchmark words.

A window is ``WINDOW`` consecutive words of an item (an item of fewer words is
one window). The search runs over words instead of bytes: a block is two words.
For all windows of one length m, the shift table says how far a cursor that
looks at the block ending at word p may move without passing the end of a
window (m - 1 words if no window holds the block). Where it says 0, the block
ends some windows: the suffix bucket of the block lists them, and a direct
comparison, first of the word hashes and then of the words' bytes, confirms an
occurrence. All texts of a batch are searched at once, each by a cursor per
stretch of ``STRETCH`` words, so that long texts don't hold up short ones.

Defined cases: a null or empty text has no words and is clean; a null or
wordless item matches nothing; an item with a null id still hits words but adds
no id; repeated items count once; repeated rows of ``docs`` each give a row; an
empty benchmark leaves all clean; other columns are ignored by
``find_windows`` and kept by ``remove_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parcelrules.llm import common as c

WINDOW = 10
STRETCH = 512
TABLE_BITS = 18                 # least size of a shift table
BLOCK_ITEM_BYTES = 16 << 20     # benchmark text searched in one pass; more items take more passes
HIT = "struct<n_words:long,spans:array<struct<start:long,length:long>>,items:array<string>>"


class Patterns:
    """The windows of one length with their tables."""

    def __init__(self, m: int, windows: dict[bytes, set[str]]):
        self.m = m
        self.texts = sorted(windows)
        self.items = [sorted(windows[t]) for t in self.texts]
        data, offsets = c.text_bytes(pa.array(self.texts, pa.large_binary()))
        starts, ends, _ = c.word_bounds(data, offsets, c.NO_WORD)
        self.words = c.range_hashes(data, starts, ends).reshape(len(self.texts), m)
        width = min(2, m)
        bits = max(TABLE_BITS, int(np.ceil(np.log2(len(self.texts) * m + 1))) + 3)
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, m - width + 1, np.int32)
        for end in range(width, m + 1):
            # A block that ends at word ``end`` lets the cursor move m - end words.
            np.minimum.at(self.shift, self.slot(self.blocks(self.words[:, end - width:end])), m - end)
        last = self.blocks(self.words[:, m - width:])
        order = np.argsort(last, kind="stable")
        self.bucket_of, self.bucket_start, self.bucket_size = np.unique(last[order], return_index=True, return_counts=True)
        self.members = order

    def slot(self, block: np.ndarray) -> np.ndarray:
        return (block & self.mask).astype(np.int64)

    @staticmethod
    def blocks(words: np.ndarray) -> np.ndarray:
        return c.mix(words[:, 0] * c.BASE + words[:, -1])


def item_windows(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> list[Patterns]:
    """The windows of all items, by their number of words."""
    by_length: dict[int, dict[bytes, set[str]]] = {}
    for item_id, text in items:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        data = c.ASCII_LOWER[raw]
        starts, ends, _ = c.word_bounds(data, np.array([0, len(data)]), c.NO_WORD)
        words = [data[s:e].tobytes() for s, e in zip(starts, ends)]
        m = min(window, len(words))
        for at in range(len(words) - m + 1 if m else 0):
            owners = by_length.setdefault(m, {}).setdefault(b" ".join(words[at:at + m]), set())
            if item_id is not None:
                owners.add(item_id)
    return [Patterns(m, windows) for m, windows in sorted(by_length.items())]


def search(p: Patterns, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start word and pattern of every place where the word hashes of a pattern occur.

    ``first`` holds each text's first word and, last, the number of words.
    """
    m, found_at, found = p.m, [], []
    size = np.diff(first)
    # Stretches own window ends; a text of n words has n - m + 1 of them.
    ends = np.maximum(size - m + 1, 0)
    parts = -(-ends // STRETCH)
    text = np.repeat(np.arange(len(size)), parts)
    part = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    cursor = first[text] + m - 1 + part * STRETCH
    stop = np.minimum(cursor + STRETCH, first[text + 1])
    before = 1 if m > 1 else 0
    while len(cursor):
        block = c.mix(words[cursor - before] * c.BASE + words[cursor])
        shift = p.shift[p.slot(block)]
        hit = np.flatnonzero(shift == 0)
        if len(hit):
            place = np.searchsorted(p.bucket_of, block[hit])
            place[place == len(p.bucket_of)] = 0
            same = p.bucket_of[place] == block[hit]
            at, place = cursor[hit[same]] - m + 1, place[same]
            count = p.bucket_size[place]
            start = np.repeat(at, count)
            k = np.arange(len(start)) - np.repeat(np.cumsum(count) - count, count)
            pattern = p.members[np.repeat(p.bucket_start[place], count) + k]
            equal = np.ones(len(start), bool)
            for i in range(m):
                equal[equal] = words[start[equal] + i] == p.words[pattern[equal], i]
            found_at.append(start[equal])
            found.append(pattern[equal])
        cursor = cursor + np.maximum(shift, 1)
        alive = cursor < stop
        cursor, stop = cursor[alive], stop[alive]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_at), np.concatenate(found)


def batch_hits(column: pa.Array, tables: list[Patterns]) -> Iterator[dict]:
    """Per text: its number of words, the hit stretches of words, and the items found."""
    raw, offsets = c.text_bytes(column)
    for low, high in c.slices(offsets):
        data = c.ASCII_LOWER[raw[offsets[low]:offsets[high]]]
        starts, ends, first = c.word_bounds(data, offsets[low:high + 1] - offsets[low], c.NO_WORD)
        words = c.range_hashes(data, starts, ends)
        items: dict[int, set[str]] = {}
        change = np.zeros(len(words) + 1, np.int32)
        for p in tables:
            for at, k in zip(*search(p, words, first)):
                shown = b" ".join(data[s:e].tobytes() for s, e in zip(starts[at:at + p.m], ends[at:at + p.m]))
                if shown == p.texts[k]:
                    change[at] += 1
                    change[at + p.m] -= 1
                    items.setdefault(int(np.searchsorted(first, at, "right")) - 1, set()).update(p.items[k])
        hit = np.cumsum(change[:-1]) > 0
        # Neighbouring windows of one text run together; two texts never do.
        opens, closes = hit.copy(), hit.copy()
        inner = first[(first > 0) & (first < len(words))]
        opens[1:] &= ~hit[:-1]
        opens[inner] = hit[inner]
        closes[:-1] &= ~hit[1:]
        closes[inner - 1] = hit[inner - 1]
        begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        of = np.searchsorted(first, begin, "right") - 1
        at = 0
        for row in range(high - low):
            spans = []
            while at < len(begin) and of[at] == row:
                spans.append({"start": int(begin[at] - first[row]), "length": int(end[at] - begin[at])})
                at += 1
            yield {"n_words": int(first[row + 1] - first[row]), "spans": spans, "items": sorted(items.get(row, ()))}


def item_blocks(benchmark: DataFrame, limit: int = BLOCK_ITEM_BYTES) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in blocks of at most ``limit`` bytes (one item at least); only one is held at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string"), "text").where(F.octet_length("text") > 0)
    for item_id, text in rows.toLocalIterator():
        if block and size + 4 * len(text) > limit:
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += 4 * len(text)
    yield block


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BLOCK_ITEM_BYTES) -> DataFrame:
    """``docs`` with a column ``windows``: number of words, hit stretches, ids of the items found.

    One pass over the texts per block of items; a pass holds the tables of one block only.
    """
    spark = docs.sparkSession
    kept = [n for n in docs.columns if n != "windows"]
    out = docs.select(*kept, F.lit(None).cast(HIT).alias("windows"))
    for block in item_blocks(benchmark, limit):
        tables = spark.sparkContext.broadcast(item_windows(block, window))

        def run(batches, tables=tables):
            for batch in batches:
                if not batch.num_rows:
                    continue
                at = batch.schema.get_field_index("windows")
                merged = []
                for old, new in zip(batch.column(at).to_pylist(), batch_hits(batch.column("text"), tables.value)):
                    if old:
                        new["items"] = sorted({*old["items"], *new["items"]})
                        new["spans"] = joined(old["spans"] + new["spans"])
                    merged.append(new)
                yield batch.set_column(at, batch.schema.field(at), pa.array(merged, batch.schema.field(at).type))

        out = out.mapInArrow(run, out.schema)
    return out


def joined(spans: list[dict]) -> list[dict]:
    """Stretches in order, those that touch made one."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["start"]):
        if out and s["start"] <= out[-1]["start"] + out[-1]["length"]:
            out[-1]["length"] = max(out[-1]["length"], s["start"] + s["length"] - out[-1]["start"])
        else:
            out.append(dict(s))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of ``find_windows``: one row per document."""
    slim = find_windows(docs.select("doc_id", "text"), benchmark)
    w = F.col("windows")
    n_hit = F.aggregate(w["spans"], F.lit(0).cast("long"), lambda total, s: total + s["length"])
    return slim.select(
        "doc_id", w["n_words"].alias("n_words"), n_hit.alias("n_hit"), F.size(w["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", w["items"]), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@c.shielding
def remove_contaminated(docs: DataFrame, benchmark: DataFrame, least_words: int = 1) -> DataFrame:
    """Documents with fewer than ``least_words`` hit words; same columns."""
    n_hit = F.aggregate(F.col("windows.spans"), F.lit(0).cast("long"), lambda total, s: total + s["length"])
    return find_windows(docs, benchmark).where(n_hit < least_words).drop("windows")
