"""Near-duplicates, repeated strings, archives, shards and URLs against plain Python."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from parcelrules.llm import components, kd_shards, order_minhash, suffix_dedup, url_filter, warc
from parcelrules.session import work_folder

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# --- near-duplicates -----------------------------------------------------------------------

def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_banded_alignment_is_exact_inside_its_band():
    rng = random.Random(2)
    for _ in range(150):
        a = [rng.randrange(rng.choice([3, 50])) for _ in range(rng.randrange(1, 60))]
        b = list(a)
        for _ in range(rng.randrange(4)):
            b[rng.randrange(len(b))] = 99
        if rng.random() < 0.5:
            b.insert(rng.randrange(len(b)), 77)
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        assert order_minhash.matched(x, y, len(a) + len(b)) == lcs(a, b)
        low, high = order_minhash.reach(x, y)
        m = lcs(a, b)
        d = 1 - m / (len(a) + len(b) - m)
        assert low - 1e-9 <= d <= high + 1e-9
        if d <= 0.2:
            assert abs(high - d) < 1e-9


def test_bands_with_many_equal_shingles():
    a = np.array([1] * 500 + [2] + [1] * 300, np.uint64)
    b = np.array([1] * 480 + [3] + [1] * 320, np.uint64)
    assert order_minhash.matched(a, b, 100) == lcs(a.tolist(), b.tolist()) == 800


def family(rng, size, edits):
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(150)]
    out = []
    for _ in range(size):
        own = list(base)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(150)] = f"e{rng.randrange(10 ** 9)}"
        out.append(" ".join(own))
    return out


def brute_classes(rows):
    words = {t: PLAIN.findall(t.lower()) for t in {t for _, t in rows if t}}
    root = {t: t for t in words}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    texts = [t for t in words if len(words[t]) >= 5]
    for i, a in enumerate(texts):
        for b in texts[:i]:
            x, y = words[a], words[b]
            both = sum((collections.Counter(x) & collections.Counter(y)).values())
            if both / (len(x) + len(y) - both) >= 0.8:
                m = lcs(x, y)
                if m / (len(x) + len(y) - m) >= 0.8:
                    root[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[find(t) if t else (i, t, len(groups))].append(i)
    return sorted(sorted(map(str, g)) for g in groups.values())


def edited(rng, words, edits):
    """``edits`` words changed, dropped or added, each kind as often."""
    own = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(own)), rng.randrange(3)
        own[at:at + (kind < 2)] = [] if kind == 1 else [f"e{rng.randrange(10 ** 9)}"]
    return own


@pytest.mark.parametrize("length, edits", [(9, 1), (12, 1), (20, 1), (20, 2), (33, 2), (41, 2), (50, 3), (150, 8), (150, 12), (600, 30), (600, 50)])
def test_near_copies_meet_at_every_length(length, edits):
    rng = random.Random(length * 100 + edits)
    near, met = 0, 0
    for _ in range(150):
        base = [f"w{rng.randrange(10 ** 6)}" for _ in range(length)]
        other = edited(rng, base, edits)
        m = lcs(base, other)
        pair = list(order_minhash.word_rows(pa.array([" ".join(base), " ".join(other)])))
        (x, _), (y, _) = pair
        assert (order_minhash.reach(x, y)[1] <= 0.2 + 1e-9) == (m / (len(base) + len(other) - m) >= 0.8)
        if m / (len(base) + len(other) - m) < 0.8:
            continue
        near += 1
        a, b = order_minhash.text_keys(pair)
        met += any(p == q != 0 for p, q in zip(a, b))
    assert near >= 75
    # One word in twenty changed is found; nearer the bound some pairs of long texts share no bucket.
    assert met >= (0.95 if length < 33 or edits <= length * 0.06 else 0.8) * near


def test_keys_of_many_texts_are_those_of_each():
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(30)}" for _ in range(n)) for n in (0, 4, 5, 6, 7, 8, 32, 40, 41, 300)]
    rows = list(order_minhash.word_rows(pa.array(texts)))
    keys = order_minhash.text_keys(rows)
    whole = order_minhash.SKETCHES + order_minhash.WORD_SKETCHES
    assert [len(k) for k in keys] == [0, 0] + [whole] * 8
    for (words, runs), own in zip(rows[2:], keys[2:]):
        assert own[:order_minhash.SKETCHES] == order_minhash.sketch(runs, order_minhash.SEEDS, order_minhash.PICKED)
        by_word = order_minhash.sketch(words, order_minhash.SEEDS[:order_minhash.WORD_SKETCHES], order_minhash.WORDS_PICKED)
        assert own[order_minhash.SKETCHES:] == (by_word if len(words) <= order_minhash.SHORT else [0] * order_minhash.WORD_SKETCHES)


def test_chance_of_a_shared_bucket():
    one, other = np.arange(10, dtype=np.uint64), np.arange(2, 12, dtype=np.uint64)
    assert order_minhash.chance(one, other, 1, 3) == pytest.approx(56 / 220)
    assert order_minhash.chance(one, one, 5, 3) == 1
    assert order_minhash.chance(one[:2], other, 5, 3) == 0


def test_classes_match_all_pairs(spark):
    rng = random.Random(4)
    texts = family(rng, 60, 6) + family(rng, 40, 2) + [f"only {i} few words" for i in range(5)] + family(rng, 3, 1)
    # Short texts: near ones, and others that share their opening only.
    title = [f"t{i}" for i in range(20)]
    texts += [" ".join(edited(rng, title, 1)) for _ in range(12)] + [" ".join(title[:10] + [f"x{i}{j}" for j in range(8)]) for i in range(12)]
    rows = list(enumerate(texts)) + [(500, texts[0]), (501, texts[0]), (502, None), (503, ""), (504, "Few WORDS"), (505, "Few WORDS")]
    got = order_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    groups = collections.defaultdict(list)
    for r in got:
        groups[r.class_id].append(r.doc_id)
    assert all(min(g) == k for k, g in groups.items())
    assert sorted(sorted(map(str, g)) for g in groups.values()) == brute_classes(rows)
    assert all(r.class_docs == len(groups[r.class_id]) for r in got)


def test_one_of_each(odd, none):
    kept = order_minhash.one_of_each(odd)
    assert kept.columns == odd.columns
    rows = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    prose = next(t for i, t in rows if i == 1)
    assert (2, prose) not in rows and (None, prose) not in rows and not any(i == 3 and t.startswith("word0") for i, t in rows)
    assert {(4, None), (5, ""), (None, None), (6, "a"), (14, next(t for i, t in rows if i == 14))} <= set(rows)
    assert max(rows.values()) == 1
    assert order_minhash.one_of_each(none).count() == 0
    assert order_minhash.classes(none).count() == 0
    assert order_minhash.classes(odd).count() == odd.count()


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 240)] + [(5, 5), (240, 239), (3, 4), (4, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(200, 241)}, 7: 7, 3: 3, 4: 3}


# --- repeated strings ---------------------------------------------------------------------------

def brute_repeats(rows):
    docs = sorted({(i is None, i or 0, t or "") for i, t in rows}, key=lambda x: x[:2])
    seen, out = set(), {}
    for none, i, t in docs:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p:p + 100] in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(b[p:p + 100])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[(None if none else i, t)] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return collections.Counter((i, *out[(i, t or "")]) for i, t in rows)


def near_edges(rng):
    shared = "".join(rng.choice("abcdefgh ") for _ in range(400))
    texts = [f"{rng.random()} {shared[rng.randrange(200):][:rng.randrange(60, 250)]}{rng.random()}" for _ in range(60)]
    return [(i, t) for i, t in enumerate(texts)] + [(70, "z" * 350), (71, "z" * 99), (72, "z" * 100), (73, "ab" * 300), (74, texts[0]),
            (74, texts[0]), (None, texts[1]), (75, None), (76, ""), (77, texts[2] + "\x00" * 130), (78, "q" + "\x00" * 120 + texts[3])]


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 3])
def test_repeats_match_all_strings(spark, odd_rows, hot):
    own = [(r[0], r[1]) for r in odd_rows if r[0] != 3]
    for rows in (near_edges(random.Random(6)), own):
        got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), hot).collect()
        assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows)
        assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_repeats_of_the_given_table(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    got = suffix_dedup.dedup(documents).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows)


def test_repeats_of_nothing(none):
    assert suffix_dedup.dedup(none).count() == 0


def test_deep_shallow_sort():
    rng = random.Random(9)
    text = [bytes(rng.choice(b"ab") for _ in range(8)) * 5 for _ in range(60)]
    text += [b"x" * 40, b"x" * 39 + b"y", b"x" * 35 + b"w" * 5, b"x" * 40, b"x" * 36 + b"zzzz", b"\0" * 40]
    order, shared = suffix_dedup.deep_shallow(text, 40)
    assert [text[k] for k in order] == sorted(text)
    for k, n in zip(range(1, len(text)), shared[1:]):
        a, b = text[order[k - 1]], text[order[k]]
        assert n == next((i for i in range(40) if a[i] != b[i]), 40)


def joined(chunks):
    return [np.concatenate(x) for x in zip(*chunks)]


def test_anchors_across_chunks(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 5000, dtype=np.uint8)
    offsets = np.array([0, 50, 1800, 5000])
    whole = joined(suffix_dedup.anchors(data, offsets))
    monkeypatch.setattr(suffix_dedup, "CHUNK", 333)
    assert all((a == b).all() for a, b in zip(whole, joined(suffix_dedup.anchors(data, offsets))))


# --- archives -----------------------------------------------------------------------------------

def test_archives(spark):
    rng = random.Random(3)
    noise = lambda n: "".join(chr(rng.randrange(32, 0x500)) for _ in range(n))
    rows = [(i, f"http://a/{i}\n", noise(rng.randrange(3000))) for i in range(60)]
    rows += [(None, None, None), (7, "x", rows[5][2] + "!" * 100), (99, "x", rows[5][2] + "!" * 100), (8, "x", "y" * 99), (9, "x", "y" * 99),
             (10, "u", "y" * 100), (11, "u", "y" * 100), (11, "u", "y" * 100), (None, "u", "y" * 100), (12, "z", "ab" * (9 << 20))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        got = warc.round_trip(pages.repartition(3), work_folder(spark, "warc")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    first = {}
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        if len((h or "").encode()) >= 100:
            first.setdefault(h, i)
    want = collections.Counter()
    for i, _, h in rows:
        b, refers = (h or "").encode(), first.get(h)
        again = len(b) >= 100 and refers != i
        want[(i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", refers if again else None)] += 1
    assert collections.Counter(tuple(r) for r in got) == want
    assert warc.round_trip(pages.where("false"), work_folder(spark, "warc")).count() == 0


@pytest.mark.parametrize("split", [300, 5000])
def test_magic_inside_stored_members(spark, tmp_path, split):
    """Members that aren't compressed show the payload's own gzip magic at any place of a range."""
    payload = {i: (b"\x1f\x8b\x08" if i % 3 else b"q") * (37 * i % 211) for i in range(40)}
    with open(tmp_path / "x.warc", "wb") as f:
        for i, p in payload.items():
            z = zlib.compressobj(level=0, wbits=31)
            f.write(z.compress(warc.record("response", i, None, "u", hashlib.sha256(p).hexdigest(), p)) + z.flush())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        got = {int(r.page_id): bytes(r.payload) for r in warc.read_archives(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == payload


# --- shards ----------------------------------------------------------------------------------------

def check_shards(rows, docs):
    got = kd_shards.shard(docs).collect()
    text = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == text
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    held = collections.Counter()
    for r in got:
        held[r.shard] += r["size"]
    return held


def test_shards(odd, odd_rows, documents, none):
    check_shards([r[:2] for r in odd_rows], odd)
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    held = check_shards(rows, documents)
    mean = sum(held.values()) / 16
    assert max(abs(held[s] - mean) for s in range(16)) <= max(len((t or "").encode()) + 1 for _, t in rows)
    assert kd_shards.shard(none).count() == 0


def test_a_hot_text_is_dealt_over_shards(spark):
    rows = [(i, "x" * 500 if i % 3 == 0 else f"text {i} " * (i % 40)) for i in range(3000)]
    held = check_shards(rows, spark.createDataFrame(rows, "doc_id long, text string"))
    mean = sum(held.values()) / 16
    assert len(held) == 16 and all(abs(x - mean) < 0.1 * mean for x in held.values())


# --- URLs -------------------------------------------------------------------------------------------

def test_urls(spark):
    urls = ["http://a.example.net/en/x", "http://example.net/en", "https://EXAMPLE.net/de?q=1#t", "http://www.example.com/de/1/",
            "http://notexample.com/de/", "http://x.org/fr/", "http://org/fr/a", None, "no scheme", "://", "http://a.net", "http://a.net?x/",
            "HTTP://bad.info/p/?b=2&utm_source=q&a=1#f", "http://www.bad.info/p?a=1&b=2", "http://bad.info/p?a=1", "http://a.b.c.net/" + "z" * 5000,
            "http://..net/", "ftp://h/://x.net/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(3, urls[3])], "page_id long, url string")
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
                                   ("org", "/fr/", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    listed = spark.createDataFrame([("https://bad.info/p?a=1&b=2",), (None,), ("http://x.org/fr/",)], "url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, rules, listed).collect()}
    assert url_filter.judge(pages, rules, listed).count() == len(urls) + 1
    want = [("example.net/en/", "allow"), (None, None), ("net/", "block"), ("example.com/de/", "block"), (None, "allow"), ("org/fr/", "allow"),
            ("org/fr/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "block"), (None, "block"),
            (None, "allow"), ("net/", "block"), ("net/", "block"), (None, "allow")]
    want[1] = ("net/", "block")
    assert [got[i] for i in range(len(urls))] == want
    empty = url_filter.judge(pages, rules.where("false"), listed.where("false"))
    assert {r.verdict for r in empty.collect()} == {"allow"}
    assert url_filter.judge(pages.where("false"), rules, listed).count() == 0


def test_filter_has_no_false_negative(spark):
    keys = spark.range(3000).selectExpr("CAST(id AS STRING) AS key")
    asked = spark.range(9000).selectExpr("CAST(id AS STRING) AS key", "id")
    got = url_filter.possible(asked, keys).where("maybe")
    assert got.where("id < 3000").count() == 3000 and got.where("id >= 3000").count() < 300


def test_components_of_settled_edges_take_no_round(spark, monkeypatch):
    """Stars on their least node need no star operation; any graph gets its least nodes."""
    edges = [(a, b) for a in range(40) for b in (a * 7 % 40, a * 11 % 40) if a % 3 == b % 3] + [(90, 91), (91, 92), (95, 95)]
    root = {x: x for e in edges[:-1] for x in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    found = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in found.collect()} == root and found.count() == len(root)
    monkeypatch.setattr(components, "large_star", lambda _: pytest.fail("a round for nothing"))
    again = components.components(found.selectExpr("root AS a", "node AS b"))
    assert {r.node: r.root for r in again.collect()} == root
