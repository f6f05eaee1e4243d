"""Secret scans: a character convolutional network over every candidate and its surroundings.

Base findings come from three patterns (assignments, access keys, hexadecimal
runs). Candidates are all base findings, and every run of ``LEAST`` or more
characters of ``[A-Za-z0-9+/_=.-]`` with a letter and a digit in it. A candidate
is shown to the network as ``BEFORE`` characters before it, its first and last
characters and ``AFTER`` behind it, one-hot by character class; ``FILTERS``
filters of ``WIDTH`` characters are followed by a maximum over the candidate and
one over its surroundings, and a logistic layer.

It learns from examples (``examples``). Secrets are the base findings as they
stand, and, of values of ``LEAST`` characters with a letter and a digit, masked
copies that no base pattern would find for their keyword or prefix: the value
without these, and re-spelled by other alphabets and joints. Clean are runs
made of words and short numbers (``WORDY``: names of hosts, files, identifiers),
in their place and rejoined by other signs. Any other run that no pattern touches
is unlabelled: it is judged, but nothing is learnt from it.

All distinct examples of all documents count (plain and masked secrets, clean runs);
two thirds train, the rest calibrate, no value being in both: a logistic fit of the network's
scores, then the highest threshold that keeps ``RECALL`` of the held-out masked
secrets, 0.5 at least. Examples are dealt by hash to groups of about ``SHARE``. Each
group trains the network for ``EPOCHS`` rounds in a task; then the groups' weights are
averaged by their examples, and the next rounds start from these. Only weights go to
the driver, and from calibration the scores' counts in bins. With fewer than 10 plain secrets or 10 clean runs, or no
masked secret on either side, nothing is learnt and only base findings are reported.

The texts are read once; findings and candidates are written to the shared
folder, and both the examples and the scores come from there.

Defined cases: a null or empty text has no findings; repeated rows give a row
each; only doc_id and text are used, and ``redact`` keeps all other columns.
"""

from __future__ import annotations

import hashlib
import pickle
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from parcelrules.llm import common as c

# The base patterns, in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")     # runs are whole, so this is every run of 24 or more
KINDS = ("assign", "access", "hex", "model")
WORD_BEFORE = r"(?i:password|passwd|secret|token|api_?key)"

LEAST = 16
BEFORE, INSIDE, AFTER = 24, 48, 8
LENGTH = BEFORE + INSIDE + AFTER
FILTERS, WIDTH = 16, 5
SHARE = 8192             # examples in a group
ROUNDS, RATE, BATCH = 30, 0.01, 128
EPOCHS = 3               # rounds between two means of the weights
BINS = 4096              # a unit of the score
RECALL = 0.98
LEAST_PROBABILITY = 0.5
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % LEAST)
FOUND = "array<struct<kind:int,start:long,end:long>>"
ASKED = "array<struct<start:long,end:long,view:binary>>"
SHOWN = "array<struct<sort:int,held:boolean,view:binary>>"
PLAIN, MASKED, CLEAN = range(3)      # the sorts of examples
KEYWORD = re.compile(r"""[A-Za-z0-9_-]*(password|passwd|secret|token|api_?key)["']?\s*[:=]\s*["']?$""", re.IGNORECASE | re.ASCII)
WORDY = re.compile(r"(?:[a-z]{0,15}|[A-Z]{0,15}|(?:[A-Z]?[a-z]{3,15}){1,6}|[A-Z][a-z]{1,15})[0-9]{0,4}|[0-9]{1,8}")
JOINTS = re.compile(r"[+/_=.-]+")
LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = (LETTERS + LETTERS.upper() + DIGITS, LETTERS + LETTERS.upper() + DIGITS + "+/", LETTERS + LETTERS.upper() + DIGITS + "_-",
             LETTERS.upper() + DIGITS, LETTERS + DIGITS)


def classes() -> np.ndarray:
    """The class of every byte: digits, hex and other letters by case, signs, space, the rest."""
    of = np.full(256, 15, np.uint8)
    for k, signs in enumerate(["0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/", "_", "-", ".", "=",
                               ":", "\"'", " ", "\n\t\r", "@#$%&*|<>"], 1):
        of[[ord(x) for x in signs]] = k - 1
    of[0] = 16           # beyond the text
    return of


CLASS = classes()
CHANNELS = 17


# --- findings -------------------------------------------------------------------------

def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base findings, by start, then kind."""
    out = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], x[0]))


def view(text: str, start: int, end: int) -> bytes:
    """What the network sees: a fixed number of characters, those outside the text as 0, others than ASCII as 1."""
    inside = text[start:end]
    if len(inside) > INSIDE:
        inside = inside[:INSIDE // 2] + inside[-INSIDE // 2:]
    before, after = text[max(0, start - BEFORE):start], text[end:end + AFTER]
    line = before.rjust(BEFORE, "\0") + inside.ljust(INSIDE, "\0") + after.ljust(AFTER, "\0")
    return line.encode("ascii", "replace") if line.isascii() else bytes(ord(x) if ord(x) < 128 else 1 for x in line)


def mixed(run: str) -> bool:
    return any(x.isdigit() for x in run) and any(x.isalpha() for x in run)


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of all runs that no base finding touches."""
    taken = [(s, e) for _, s, e in spans]
    return [m.span() for m in CANDIDATE.finditer(text) if mixed(m.group()) and not any(s < m.end() and m.start() < e for s, e in taken)]


def respelled(value: str, style: int) -> str:
    """Another secret in place of ``value``, always the same: by one of the alphabets, plain, behind a short name, or in three parts."""
    r = hashlib.shake_256(f"{style}:{value}".encode()).digest(80)
    alphabet = ALPHABETS[r[0] % len(ALPHABETS)]
    made = "".join(alphabet[x % len(alphabet)] for x in r[8:8 + 20 + r[1] % 45])
    if style == 1:
        name = "".join(LETTERS[x % 26] for x in r[3:5 + r[2] % 4])
        return name + "_-"[r[7] % 2] + made
    if style == 2:
        third = len(made) // 3
        return "._-"[r[7] % 3].join([made[:third], made[third:2 * third], made[2 * third:]])
    return made


def examples(text: str, spans: list[tuple[int, int, int]], runs: list[tuple[int, int]]) -> list[tuple[int, bool, bytes]]:
    """(sort, kept for calibration, view): secrets as they stand and masked, and runs that are surely clean."""
    out = []

    def around(before: str, value: str, after: str) -> bytes:
        return view(before + value + after, len(before), len(before) + len(value))

    for kind, start, end in spans:
        own = CANDIDATE.search(text, start, end)
        at = ASSIGN.match(text, start).start(2) if kind == 0 else start
        value = text[at:end]
        held = hashlib.sha256(value.encode()).digest()[0] % 3 == 0
        out.append((PLAIN, held, view(text, *(own.span() if own else (start, end)))))
        if len(value) >= LEAST and mixed(value) and not WORDY.fullmatch(value):
            before = KEYWORD.sub("", text[max(0, at - 4 * BEFORE):at])
            after = text[end:end + AFTER + 1].lstrip("\"'")
            for shown in [value.removeprefix("AKIA"), *[respelled(value, k) for k in range(3)]]:
                out.append((MASKED, held, around(before, shown, after)))
    for start, end in runs:
        parts = [x for x in JOINTS.split(text[start:end]) if x]
        if all(WORDY.fullmatch(x) for x in parts):
            seen = view(text, start, end)
            held = hashlib.sha256(seen).digest()[0] % 3 == 0
            joint = "_-./"[hashlib.sha256(seen).digest()[1] % 4]
            before = text[max(0, start - 4 * BEFORE):start].rstrip("@/:")
            out += [(CLEAN, held, seen), (CLEAN, held, around(before, joint.join(parts), text[end:end + AFTER]))]
    return out


def findings(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of ``docs`` with ``_found``, ``_asked`` and ``_shown``."""
    base = f"{WORD_BEFORE}|AKIA|[0-9a-f]{{24}}"
    schema = T.StructType([docs.schema[n] for n in keep] + T.StructType.fromDDL(f"_found {FOUND}, _asked {ASKED}, _shown {SHOWN}").fields)
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
    cell = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("view", pa.binary())]))
    example = pa.list_(pa.struct([("sort", pa.int32()), ("held", pa.bool_()), ("view", pa.binary())]))

    def scan(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            # Texts without any part of a pattern are passed by; nothing else is skipped.
            may = pc.match_substring_regex(texts, base).to_pylist()
            digit = pc.match_substring_regex(texts, "[0-9]").to_pylist()
            found, asked, shown = [], [], []
            for text, a, b in zip(texts.to_pylist(), may, digit):
                spans = base_spans(text) if a else []
                found.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                own = candidates(text, spans) if a or b else []
                asked.append([{"start": s, "end": e, "view": view(text, s, e)} for s, e in own])
                shown.append([{"sort": k, "held": held, "view": seen} for k, held, seen in examples(text, spans, own)])
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], pa.array(found, span), pa.array(asked, cell),
                                              pa.array(shown, example)], names=[f.name for f in schema])

    wanted = docs.select(*dict.fromkeys([*keep, "text"]))
    return wanted.mapInArrow(scan, schema)


# --- the network ----------------------------------------------------------------------

class Network:
    """Convolution, rectifier, maxima over the candidate and its surroundings, logistic layer."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.weights = {"f": r.normal(0, 0.2, (WIDTH * CHANNELS, FILTERS)), "fb": np.zeros(FILTERS),
                        "o": r.normal(0, 0.2, (2 * FILTERS + 1, 1)), "ob": np.zeros(1)}
        self.slope, self.shift, self.threshold = 1.0, 0.0, 1.1

    @staticmethod
    def patches(views: np.ndarray) -> np.ndarray:
        one_hot = np.eye(CHANNELS, dtype=np.float32)[CLASS[views]]
        window = np.lib.stride_tricks.sliding_window_view(one_hot, WIDTH, axis=1)
        return window.transpose(0, 1, 3, 2).reshape(len(views), LENGTH - WIDTH + 1, WIDTH * CHANNELS)

    def forward(self, views: np.ndarray) -> dict:
        w = self.weights
        x = self.patches(views)
        a = np.maximum(x @ w["f"].astype(np.float32) + w["fb"].astype(np.float32), 0)
        inner = slice(BEFORE, BEFORE + INSIDE - WIDTH + 1)
        own, around = a.copy(), a.copy()
        own[:, :BEFORE] = own[:, inner.stop:] = -1
        around[:, inner] = -1
        top, side = own.argmax(1), around.argmax(1)
        length = (views[:, BEFORE:BEFORE + INSIDE] != 0).sum(1, keepdims=True) / INSIDE
        h = np.concatenate([np.take_along_axis(a, top[:, None], 1)[:, 0], np.take_along_axis(a, side[:, None], 1)[:, 0], length], 1)
        return {"x": x, "h": h, "top": top, "side": side, "z": (h @ w["o"] + w["ob"])[:, 0]}

    def gradients(self, views: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        s = self.forward(views)
        dz = ((1 / (1 + np.exp(-s["z"])) - labels) / len(labels))[:, None]
        dh = dz @ self.weights["o"].T
        g = {"o": s["h"].T @ dz, "ob": dz.sum(0), "f": np.zeros_like(self.weights["f"]), "fb": np.zeros(FILTERS)}
        rows = np.arange(len(views))
        for part, at in ((0, s["top"]), (FILTERS, s["side"])):
            for k in range(FILTERS):
                d = dh[:, part + k] * (s["h"][:, part + k] > 0)
                g["f"][:, k] += s["x"][rows, at[:, k]].T @ d
                g["fb"][k] += d.sum()
        return g

    def start(self) -> dict:
        """What training carries from round to round: weights, Adam's two means and the number of steps."""
        zero = {k: np.zeros_like(v) for k, v in self.weights.items()}
        return {"w": self.weights, "m": zero, "v": {k: x.copy() for k, x in zero.items()}, "step": 0.0}

    def train(self, views: np.ndarray, labels: np.ndarray) -> None:
        """All rounds over one group."""
        self.weights = self.rounds(self.start(), views, labels, 0, ROUNDS)["w"]

    @staticmethod
    def rounds(state: dict, views: np.ndarray, labels: np.ndarray, begin: int, end: int) -> dict:
        """Adam over mini-batches, in a fixed order, for the rounds from ``begin`` to ``end``."""
        net = Network()
        net.weights, m, v, step = (copied(state["w"]), copied(state["m"]), copied(state["v"]), state["step"])
        r = np.random.default_rng(11)
        for turn in range(end):
            order = r.permutation(len(views))
            if turn < begin:
                continue
            for at in range(0, len(order), BATCH):
                step += 1
                pick = order[at:at + BATCH]
                for k, g in net.gradients(views[pick], labels[pick]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    net.weights[k] -= RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        return {"w": net.weights, "m": m, "v": v, "step": step}

    def calibrate(self, views: np.ndarray, labels: np.ndarray) -> None:
        """The fit, and the highest threshold that keeps the recall, of one group."""
        z = self.scores(views)
        self.fit(z, labels, 1 - labels)
        secrets = np.sort(z[labels == 1])
        self.keep(secrets[int((1 - RECALL) * len(secrets))])

    def keep(self, least: float) -> None:
        """What scores ``least`` is reported, if it is a secret rather than not."""
        self.threshold = max(float(self.likely(least)), LEAST_PROBABILITY)

    def fit(self, z: np.ndarray, secrets: np.ndarray, clean: np.ndarray) -> None:
        """A logistic fit of scores ``z``, each that of so many secrets and clean runs."""
        n = secrets + clean
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -700, 700)))
            w = n * (p * (1 - p) + 1e-6)
            h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            off = n * p - secrets
            move = np.clip(np.linalg.solve(h, np.array([(off * z).sum(), off.sum()])), -0.5, 0.5)
            self.slope, self.shift = self.slope - move[0], self.shift - move[1]

    def likely(self, z):
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -60, 60)))

    def scores(self, views: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(views[i:i + 1024])["z"] for i in range(0, len(views), 1024)]) if len(views) else np.zeros(0)

    def probabilities(self, views: np.ndarray) -> np.ndarray:
        return self.likely(self.scores(views))


def copied(arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: x.copy() for k, x in arrays.items()}


def mean_state(parts: list[tuple[int, dict]]) -> dict:
    """The mean of the groups' states by their numbers of examples."""
    total = sum(n for n, _ in parts)
    if len(parts) == 1:
        return parts[0][1]
    mean = lambda pick: {k: sum(n / total * pick(s)[k] for n, s in parts) for k in pick(parts[0][1])}
    return {p: mean(lambda s: s[p]) for p in ("w", "m", "v")} | {"step": sum(n / total * s["step"] for n, s in parts)}


def as_views(cells: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.uint8).reshape(len(cells), LENGTH)


def dealt(cells: DataFrame, groups: int) -> DataFrame:
    """The examples (sort, held, view) as a row per group: number, sorts, held and views, in a fixed order."""
    cells = cells.select(F.pmod(F.xxhash64("view"), F.lit(groups)).alias("number"), F.struct("sort", F.xxhash64("view").alias("h"), "view", "held").alias("a"))
    rows = cells.repartition(groups, "number").groupBy("number").agg(F.array_sort(F.collect_list("a")).alias("a"))
    return rows.select("number", *[F.col(f"a.{n}").alias(n) for n in ("sort", "held", "view")])


def trained(groups: DataFrame) -> Network:
    """The network trained on all groups' examples that are not held back."""
    net = Network()
    state = net.start()

    def learn(begin: int, state: dict):
        def run(batches):
            for batch in batches:
                for number, sorts, held, views in zip(*(batch.column(n).to_pylist() for n in ("number", "sort", "held", "view"))):
                    own = ~np.array(held, bool)
                    labels = (np.array(sorts)[own] != CLEAN).astype(np.float64)
                    made = Network.rounds(state, as_views(views)[own], labels, begin, min(begin + EPOCHS, ROUNDS))
                    yield pa.RecordBatch.from_pydict({"number": [number], "n": [int(own.sum())], "state": [pickle.dumps(made)]})

        return run

    for begin in range(0, ROUNDS, EPOCHS):
        rows = groups.mapInArrow(learn(begin, state), "number long, n long, state binary").where("n > 0").collect()
        state = mean_state([(r["n"], pickle.loads(r["state"])) for r in sorted(rows, key=lambda r: r["number"])])
    net.weights = state["w"]
    return net


def fitted(shown: DataFrame, share: int = SHARE) -> Network | None:
    """The network trained and calibrated on all examples, in groups of about ``share``; None without enough of them."""
    cells = c.materialised(shown.select(F.explode("shown").alias("a")).select("a.sort", "a.held", "a.view").distinct(), "examples")
    count = {(r["sort"], r["held"]): r["count"] for r in cells.groupBy("sort", "held").count().collect()}
    of = lambda sort: count.get((sort, False), 0) + count.get((sort, True), 0)
    if of(PLAIN) < 10 or of(CLEAN) < 10 or any((k, h) not in count for k in (MASKED, CLEAN) for h in (False, True)):
        return None
    learnt = sum(n for (_, held), n in count.items() if not held)
    groups = c.materialised(dealt(cells, -(-learnt // share)), "example-groups")
    net = trained(groups)

    # Plain secrets are found without the network, so they don't count for its recall.
    def score(batches):
        for batch in batches:
            for sorts, held, views in zip(*(batch.column(n).to_pylist() for n in ("sort", "held", "view"))):
                sorts = np.array(sorts)
                judged = np.array(held, bool) & (sorts != PLAIN)
                yield pa.RecordBatch.from_pydict({"z": net.scores(as_views(views)[judged]), "secret": sorts[judged] != CLEAN})

    scores = c.materialised(groups.mapInArrow(score, "z double, secret boolean"), "scores", narrow=True)
    at_bin = F.floor(F.col("z") * BINS)
    bins = scores.groupBy(at_bin.alias("bin")).agg(F.avg("z").alias("z"), F.count_if("secret").alias("secrets"), F.count_if(~F.col("secret")).alias("clean"))
    rows = sorted(bins.collect(), key=lambda r: r["bin"])
    z, secrets, clean = (np.array([r[n] for r in rows], np.float64) for n in ("z", "secrets", "clean"))
    net.fit(z, secrets, clean)
    # The secret of that rank is in the first bin up to which there are more.
    rank, below = int((1 - RECALL) * secrets.sum()), np.cumsum(secrets)
    first = int(np.searchsorted(below, rank, "right"))
    skip = rank - int(below[first - 1] if first else 0)
    least = scores.where(F.col("secret") & (at_bin == rows[first]["bin"])).orderBy("z").offset(skip).limit(1).collect()[0]["z"]
    net.keep(least)
    return net


def scanned(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns with ``_spans``: base findings and what the network finds, by start, then kind."""
    raw = c.materialised(findings(docs, keep), "secrets")
    net = raw.sparkSession.sparkContext.broadcast(fitted(raw.select(F.col("_shown").alias("shown"))))
    schema = T.StructType([raw.schema[n] for n in keep] + [T.StructField("_spans", raw.schema["_found"].dataType)])

    def judge(batches):
        for batch in batches:
            found, asked = batch.column("_found").to_pylist(), batch.column("_asked").to_pylist()
            more = [(i, a) for i, row in enumerate(asked) for a in row]
            if net.value and more:
                for (i, a), p in zip(more, net.value.probabilities(as_views([a["view"] for _, a in more]))):
                    if p >= net.value.threshold:
                        found[i].append({"kind": len(KINDS) - 1, "start": a["start"], "end": a["end"]})
            spans = [sorted(row, key=lambda s: (s["start"], s["kind"])) for row in found]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], pa.array(spans, batch.schema.field("_found").type)],
                                             names=[f.name for f in schema])

    return raw.mapInArrow(judge, schema)


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"),
                                                                s["end"].cast("string"))), ",")


def report(documents: DataFrame) -> DataFrame:
    """Counts and digests of every document's findings."""
    out = scanned(documents, ["doc_id"])
    spans = F.col("_spans")

    def of_kind(k: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    return out.select("doc_id", *[of_kind(k) for k in range(3)], F.sha2(joined(F.filter(spans, lambda s: s["kind"] < 3)), 256)
                      .alias("base_sha256"), joined(spans).alias("spans"))


@c.shielding
def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; a column n_chars follows the new text. Same columns."""
    out = scanned(docs, docs.columns)
    # Overlapping spans become one; the text between them is kept.
    merged = F.aggregate("_spans", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("done")), lambda s, x: F.when(
        x["start"] >= s["at"], F.struct(x["end"].alias("at"), F.concat(
            s["done"], F.substr(F.col("text"), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mark)).alias("done")))
        .otherwise(F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["done"].alias("done"))),
        lambda s: F.concat(s["done"], F.substr(F.col("text"), (s["at"] + 1).cast("int"))))
    text = F.when(F.size("_spans") > 0, merged).otherwise(F.col("text"))
    cleaned = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.when(F.size("_spans") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return cleaned.select(*docs.columns)
