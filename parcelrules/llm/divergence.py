"""Quality rules: distribution divergence from a language's reference, DataFrame work only.

Two histograms are taken of every text: its character classes, and the common
words of its language (with all other words as one more bin). The reference of a
language is the mean of its documents' normalised histograms, over all documents
with at least ``LEAST_WORDS`` words. A document is rejected if the Jensen-Shannon
distance (base 2, so 0 to 1) of its character classes exceeds ``MOST_CHARS``, or
that of its words ``MOST_WORDS``. Short texts have unreliable histograms: under
``LEAST_WORDS`` words nothing is judged, and the words' limit holds from
``LEAST_COMMON`` words on. A language without a list below has no reference, so
its documents are not judged by divergence.

Beside these, ``measured`` gives plain counts of words, symbols, repeated lines
and words in repeated three-word windows; windows are told apart by a 64-bit hash
within their text.

Defined cases: a null or empty text has no words and fails the plain rule; a null
or unknown language is not judged by divergence; repeated rows are judged each;
``keep_good`` returns its input's columns, whatever they are named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelrules.functions.text import let
from parcelrules.llm import common as c

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[ \t-\r]+"
SYMBOLS = "#*$%&|<>"
CLASSES = {"lower": "[^a-z]+", "upper": "[^A-Z]+", "digit": "[^0-9]+", "space": r"[^ \t-\r]+",
           "stop": r"""[^.,;:!?'"()-]+""", "symbol": r"[^#*$%&|<>@=/\\_+~^`{}\[\]]+"}
# Frequent words of four languages.
COMMON = {
    "en": ["the", "of", "and", "a", "to", "in", "is", "that", "it", "was", "for", "on", "with", "as", "by", "are"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist", "ein", "eine", "für", "im", "nicht", "auf"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "au"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"],
}
BINS = 16
LEAST_WORDS = 50
LEAST_COMMON = 100
MOST_CHARS = 0.30
MOST_WORDS = 0.26


def windows_repeated(words: Column) -> Column:
    """How many words lie in a three-word window that occurs twice or more."""

    def covered(windows: Column) -> Column:
        ranked = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = let(ranked, lambda r: F.transform(F.filter(F.transform(r, lambda x, k: F.struct(
            x["i"].alias("i"), ((F.get(r, k - 1)["h"] == x["h"]).eqNullSafe(True)
                                | (F.get(r, k + 1)["h"] == x["h"]).eqNullSafe(True)).alias("twice"))),
            lambda x: x["twice"]), lambda x: x["i"]))
        return F.size(F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2)))))

    def count(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(words, count))


def common_counts(words: Column, lang: Column) -> Column:
    """Counts of the language's common words and of the rest; null without a list."""
    def counts(names: list[str]) -> Column:
        known = F.transform(F.filter(words, lambda w: F.lower(w).isin(names)), F.lower)
        return let(known, lambda k: F.concat(
            F.array(*[(F.size(k) - F.size(F.array_remove(k, n))).cast("long") for n in names]),
            F.array((F.size(words) - F.size(k)).cast("long"))))

    out = F.when(F.lit(False), F.lit(None).cast("array<bigint>"))
    for name, names in COMMON.items():
        out = out.when(lang == name, counts(names))
    return out


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` (text, lang, ...) with ``_m``: the plain counts and both histograms."""
    kept = docs.columns
    text = F.coalesce("text", F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    staged = docs.select(*kept, F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN)).alias("_w"),
                         F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "").alias("_l"))
    classes = [F.length(F.regexp_replace(text, p, "")).cast("long") for p in CLASSES.values()]
    length = F.length(text).cast("long")
    chars = let(F.array(*classes), lambda a: F.concat(a, F.array(length - F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x))))
    return staged.select(*kept, F.struct(
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (length - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        windows_repeated(F.col("_w")).cast("long").alias("n_repeat_words"),
        chars.alias("chars"), common_counts(F.col("_w"), F.col("lang")).alias("common")).alias("_m"))


def shares(counts: Column) -> Column:
    """A histogram that sums to 1; null for an empty one."""
    return let(counts, lambda a: let(F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x),
                                     lambda n: F.when(n > 0, F.transform(a, lambda x: x / n))))


def references(measures: DataFrame) -> DataFrame:
    """Per language with a list (four rows at most): the mean shares of its longer documents."""
    sound = measures.where((F.col("_m.n_words") >= LEAST_WORDS) & F.col("lang").isin(*COMMON)).select(
        "lang", shares(F.col("_m.chars")).alias("chars"), shares(F.col("_m.common")).alias("common"))
    mean = {"chars": len(CLASSES) + 1, "common": BINS + 1}
    return sound.groupBy("lang").agg(*[F.array(*[F.avg(F.get(k, F.lit(i))) for i in range(n)]).alias(f"_{k}")
                                       for k, n in mean.items()]).withColumnRenamed("lang", "_lang")


def distance(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance of two histograms of shares."""
    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    total = F.aggregate(F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def judged(measures: DataFrame) -> DataFrame:
    """``measures`` with base_failed, char_distance, word_distance and kept."""
    # At most one row per language with a list: four.
    both = measures.join(F.broadcast(references(measures)), F.col("lang") == F.col("_lang"), "left")
    m = F.col("_m")
    failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    both = both.withColumns({"_failed": failed, "_char_distance": distance(shares(m["chars"]), F.col("_chars")),
                             "_word_distance": distance(shares(m["common"]), F.col("_common"))})
    far = F.coalesce(F.col("_char_distance") > MOST_CHARS, F.lit(False)) | (
        (m["n_words"] >= LEAST_COMMON) & F.coalesce(F.col("_word_distance") > MOST_WORDS, F.lit(False)))
    return both.withColumn("_kept", ~F.col("_failed") & ~far).drop("_lang", "_chars", "_common")


def quality(documents: DataFrame) -> DataFrame:
    """The counts and verdict of every document."""
    slim = measured(documents.select("doc_id", "lang", "text")).drop("text")
    out = judged(c.materialised(slim, "quality"))
    return out.select("doc_id", *[f"_m.{n}" for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                      F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"),
                      F.col("_char_distance").alias("char_distance"), F.col("_word_distance").alias("word_distance"))


@c.shielding
def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass; same columns. The texts are measured once and written with their measures."""
    return judged(c.materialised(measured(docs), "quality-docs")).where("_kept").select(*docs.columns)
