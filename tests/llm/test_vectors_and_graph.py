"""Hard negatives, clusters and repeated word windows against plain Python."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from conftest import key
from parcelrules.llm import debruijn, hard_negatives as hn, pca_clusters as pc

VECTORS = "vec_id long, embedding array<double>, label int, part string, tile int"


def vector(seed, size=64, scale=1.0):
    r = random.Random(seed)
    return [r.uniform(-scale, scale) for _ in range(size)]


@pytest.fixture(scope="module")
def odd_vectors():
    rows = [(i, vector(i % 90), i % 10) for i in range(160)]                     # copies under other ids
    rows += [(200, [math.nan] * 64, 1), (250, [math.inf] + [0.0] * 63, 2), (300, [None] + [0.5] * 63, 3), (350, None, 4), (400, vector(5), None),
             (450, vector(7), -3), (None, vector(8), 8), (None, vector(150), 5), (50, vector(50), 0), (50, vector(51), 7), (500, [0.0] * 64, 1),
             (550, vector(9, scale=40.0), 3), (551, [], 3), (552, vector(3, 10), 3), (553, vector(3, 65), 3), (-100, vector(4), 4)]
    return [(i, v, label, "p", 7) for i, v, label in rows]


def whole(v):
    return [math.floor(256 * x) for x in v]


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def mined(rows):
    kept = [(i, whole(v), ((label + 1) - 10 * int((label + 1) / 10) if i is not None and i % 7 == 0 else label)) for i, v, label, *_ in rows
            if label is not None and sound(v)]
    out = []
    for a, (anchor, q, label) in enumerate(kept):
        if anchor is None or anchor % 50:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(q, p)), i is None, i or 0, lab) for i, p, lab in kept))
        same = [s for s in scored if s[3] == label and (s[1] or s[2] != anchor)][:5]
        for minus, none, number, _ in same:
            fits = [s for s in scored if s[3] != label and 50 * -minus <= 100 * -s[0] <= 95 * -minus][:3]
            for rank, s in enumerate(fits, 1):
                out.append((anchor, None if none else number, rank, None if s[1] else s[2], -minus, -s[0]))
    return sorted(out, key=key)


def test_hard_negatives(spark, odd_vectors):
    df = spark.createDataFrame(odd_vectors, VECTORS)
    want = mined(odd_vectors)
    got = sorted((tuple(r) for r in hn.hard_negatives(df).collect()), key=key)
    assert got == want and len(want) > 20
    assert hn.hard_negatives(df.where("false")).count() == 0


@pytest.mark.parametrize("scale", [1, 300, 1 << 20, 1 << 27])
def test_packed_products(scale):
    r = np.random.default_rng(scale)
    a, b = (np.floor(r.uniform(-scale, scale, (n, 37))) for n in (5, 23))
    want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
    assert hn.products(a, b).tolist() == want
    assert hn.products(a[:, :0], b[:, :0]).tolist() == [[0] * 23] * 5
    with pytest.raises(ValueError, match="long"):
        hn.products(np.full((1, 2), 2.0 ** 60), np.full((1, 2), 2.0 ** 60))


def test_equal_scores_go_by_place():
    scores = np.array([[5, 7, 7, -3], [1 << 55, 0, 1 << 55, -1]])
    assert np.argsort(-hn.order_keys(scores), axis=1).tolist() == [[1, 2, 0, 3], [0, 2, 1, 3]]


def clustered(rows, k=40, rounds=5):
    kept = [(i, whole(v)) for i, v, *_ in rows if sound(v) and len(v) == 64]
    order = sorted(kept, key=lambda x: (x[0] is None, hashlib.sha256(f"2:{x[0]}".encode()).hexdigest(), np.array(x[1], "<i4").tobytes()))
    centroids = [q for _, q in order[:k]]
    for left in range(rounds, -1, -1):
        near = [min((sum((x - y) ** 2 for x, y in zip(q, m)), n) for n, m in enumerate(centroids)) for _, q in kept]
        if left:
            for n in range(len(centroids)):
                own = [q for (_, q), (_, number) in zip(kept, near) if number == n]
                if own:
                    centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    inertia = [sum(d for d, number in near if number == n) for n in range(len(centroids))]
    return sorted(((i, n, d, inertia[n], sum(inertia), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest())
                   for (i, _), (d, n) in zip(kept, near)), key=key)


@pytest.mark.parametrize("rows", [180, 12])
def test_clusters(spark, odd_vectors, rows):
    own = odd_vectors[-rows:]
    got = sorted((tuple(r) for r in pc.clusters(spark.createDataFrame(own, VECTORS)).collect()), key=key)
    assert got == clustered(own)


def test_clusters_of_nothing_and_of_too_much(spark, odd_vectors):
    df = spark.createDataFrame(odd_vectors, VECTORS)
    assert pc.clusters(df.where("false")).collect() == []
    with pytest.raises(Exception, match="too large"):
        pc.clusters(spark.createDataFrame([(1, [1e9] * 64, 1, "p", 7)], VECTORS))


def test_filter_is_exact_and_skips():
    r = np.random.default_rng(3)
    centre = r.integers(-200, 200, (40, 64))
    q = centre[r.integers(0, 40, 2000)] + r.integers(-30, 30, (2000, 64))
    axes = np.linalg.eigh(np.cov(q.T))[1].T[::-1].copy()
    nearest, far, measured = pc.Centroids(centre, axes).nearest(q, *pc.rotated(q, axes))
    every = ((q[:, None] - centre) ** 2).sum(axis=2)
    assert nearest.tolist() == every.argmin(axis=1).tolist() and far.tolist() == every.min(axis=1).tolist()
    assert measured < 0.2 * every.size


def without_repeats(texts):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    seen = {}
    for own in words:
        for a in range(len(own) - 34):
            seen[tuple(own[a:a + 35])] = seen.get(tuple(own[a:a + 35]), 0) + 1
    out = []
    for own in words:
        gone = [False] * len(own)
        for a in range(len(own) - 34):
            if seen[tuple(own[a:a + 35])] > 1:
                gone[a:a + 35] = [True] * 35
        kept = b" ".join(w for w, g in zip(own, gone) if not g)
        out.append((len(own), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.fixture(scope="module")
def shared_passages():
    r = random.Random(11)
    word = lambda n: " ".join(r.choice("abcdefghij") * r.randint(1, 4) + str(r.randint(0, 40)) for _ in range(n))
    passages = [word(n) for n in (34, 35, 36, 60, 200)]
    base = word(150).split(" ")
    texts = []
    for i in range(60):
        edited = list(base)
        for _ in range(i % 4):
            edited[r.randrange(150)] = "edit"
        texts += [" ".join(edited), word(r.randint(0, 30)) + "\n\t " + r.choice(passages) + "  " + word(20) + " " + r.choice(passages)]
    texts += [passages[4] + " " + passages[4], "a b " * 100, "x " * 90, "x " * 36, "  " * 40, "w" * 300_000 + " " + passages[3], None, ""]
    return texts + [" ".join(base[40:100]), word(5000), texts[3].replace(" ", "\n")]


@pytest.mark.parametrize("bits", [27, 7])
def test_repeated_windows(spark, shared_passages, bits):
    df = spark.createDataFrame([(None if i % 9 == 0 else i // 2, t, i) for i, t in enumerate(shared_passages)], "doc_id long, text string, row int").repartition(5)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in debruijn.dedup(df, bits).collect()), key=key)
    want = sorted(((None if i % 9 == 0 else i // 2, *x) for i, x in enumerate(without_repeats(shared_passages))), key=key)
    assert got == want and sum(x[2] for x in want) > 5000


def test_odd_rows_and_nothing(odd, none):
    texts = odd.select("doc_id", "text").collect()
    got = sorted((tuple(r)[:4] for r in debruijn.dedup(odd).collect()), key=key)
    assert got == sorted(((r["doc_id"], *x) for r, x in zip(texts, without_repeats([r["text"] for r in texts]))), key=key)
    assert debruijn.dedup(none).count() == 0


@pytest.mark.parametrize("piece", [33, 100, 1 << 17])
def test_every_window_lies_in_one_stretch(monkeypatch, shared_passages, piece):
    monkeypatch.setattr(debruijn, "PIECE", piece)
    texts = [debruijn.plain((t or "").encode()) for t in shared_passages]
    words = debruijn.Words(texts)
    found = [(int(a), int(n)) for begin, n, _, _ in debruijn.stretches(words.hashes(), words.first) for a, n in zip(begin, n)]
    starts = [w for a, n in found for w in range(a, a + n)]
    sizes = [len(t.split(b" ")) if t else 0 for t in texts]
    assert starts == [first + w for first, size in zip(np.cumsum([0, *sizes]).tolist(), sizes) for w in range(size - 34)]


def test_paths_join_copies(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), "start " + " ".join(words[50:250]), " ".join(words[100:300]) + " end", "other " * 10]
    found = debruijn.repeated_paths(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()
    spans = {(r["doc_id"], r["start"], r["end"]) for r in found}
    assert {d for d, *_ in spans} == {0, 1, 2} and min(s for d, s, _ in spans if d == 0) == 50 and max(e for d, _, e in spans if d == 0) == 300
    assert (1, 1, 201) in spans and (2, 0, 200) in spans and len({(r["path_row"], r["path_start"]) for r in found}) == 1
