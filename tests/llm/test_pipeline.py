"""The whole pipeline, and its quality rules, against plain Python."""

import collections
import math
import re

import numpy as np
import pytest

import corpus_pipeline
from parcelrules.llm import divergence
from parcelrules.llm.suite import tokenizer_path
from test_group_operators import brute_classes
from test_text_operators import WORD, base_spans, brute_hits, brute_windows

CLASSES = ["[a-z]", "[A-Z]", "[0-9]", r"[ \t-\r]", r"""[.,;:!?'"()-]""", r"[#*$%&|<>@=/\\_+~^`{}\[\]]"]


def shares(counts):
    total = sum(counts)
    return [x / total for x in counts] if total else None


def jensen_shannon(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a > 0)
    return math.sqrt(max(0.0, (kl(p) + kl(q)) / 2))


def brute_quality(rows):
    """Indices of the rows (doc_id, text, lang) that stay."""
    seen = []
    for _, text, lang in rows:
        text = text or ""
        words = WORD.findall(text)
        classes = [len(re.findall(p, text)) for p in CLASSES]
        chars = shares([*classes, len(text) - sum(classes)])
        common = None
        if lang in divergence.COMMON:
            known = collections.Counter(w.lower() for w in words)
            own = [known[n] for n in divergence.COMMON[lang]]
            common = shares([*own, len(words) - sum(own)])
        at = collections.defaultdict(list)
        for a in range(len(words) - 2):
            at[tuple(words[a:a + 3])].append(a)
        repeat = {p + k for x in at.values() if len(x) > 1 for p in x for k in range(3)}
        seen.append((lang, len(words), chars, common, len(words) < 50 or 100 * len(repeat) > 50 * len(words)))
    mean = lambda v: [sum(x) / len(v) for x in zip(*v)]
    reference = {}
    for lang in divergence.COMMON:
        own = [s for s in seen if s[0] == lang and s[1] >= divergence.LEAST_WORDS]
        if own:
            reference[lang] = mean([s[2] for s in own]), mean([s[3] for s in own])
    kept = []
    for i, (lang, n, chars, common, failed) in enumerate(seen):
        far = lang in reference and chars and (
            jensen_shannon(chars, reference[lang][0]) > divergence.MOST_CHARS
            or (n >= divergence.LEAST_COMMON and jensen_shannon(common, reference[lang][1]) > divergence.MOST_WORDS))
        if not failed and not far:
            kept.append(i)
    return kept


def redacted(text):
    out, at = "", 0
    for start, _, end in base_spans(text):
        if start >= at:
            out += text[at:start] + "[secret]"
        at = max(at, end)
    return out + text[at:]


@pytest.mark.parametrize("table", ["given", "odd"])
def test_stages_against_plain_python(spark, folder, odd, table):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{folder}/documents.parquet") if table == "given" else odd.select(columns)
    stages = dict(corpus_pipeline.STAGES)
    shown = lambda df: collections.Counter((r.doc_id, r.text) for r in df.collect())

    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    docs = stages["quality rules"](spark, docs, folder)
    assert docs.columns == columns
    assert shown(docs) == collections.Counter(rows[i][:2] for i in brute_quality(rows))

    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    docs = stages["near-duplicates"](spark, docs, folder)
    kept = [r.doc_id for r in docs.collect()]
    groups = brute_classes(rows)
    assert docs.columns == columns and len(kept) == len(groups)
    least = [min((int(x) for x in g if x != "None"), default=None) for g in groups]
    assert sorted(map(str, kept)) == sorted(map(str, least))

    items = spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    windows = brute_windows([(str(r.item_id), r.text) for r in items])
    before = shown(docs)
    docs = stages["benchmark decontamination"](spark, docs, folder)
    assert docs.columns == columns
    assert shown(docs) == collections.Counter({k: n for k, n in before.items() if not brute_hits(k[1], windows)[-1]})

    before = shown(docs)
    docs = stages["secret scans"](spark, docs, folder)
    assert docs.columns == columns
    assert shown(docs) == collections.Counter({(i, redacted(t) if t else t): n for (i, t), n in before.items()})
    assert all(r.text is None or r.n_chars == len(r.text) for r in docs.collect())

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    length = collections.Counter((r.doc_id, len(t.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in docs.collect())
    pieces = stages["packing"](spark, docs, folder).collect()
    assert collections.Counter((p.doc_id, p.doc_tokens) for p in pieces if p.start == 0) == length
    total = collections.Counter()
    for p in pieces:
        total[p.doc_id] += p.length
    assert sum(total.values()) == sum(n * k for (_, n), k in length.items())


def test_run_is_the_stages_in_order(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "benchmark decontamination", "secret scans", "packing"]
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and np.all([p.length > 0 for p in out.collect()])
