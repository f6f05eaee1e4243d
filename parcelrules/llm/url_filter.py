"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join.

Two lists can be asked: rules (host and path prefix, with a verdict; a rule fits
its host and all subdomains, the longest one wins) and listed URLs (a canonical
URL is blocked if it is on the list). A page asks for a few keys: its canonical
URL, and each of its host's suffixes with each path prefix of a length that some
rule has. The filter holds the listed keys in blocks of ``BLOCK_BITS`` bits; a
key sets ``PROBES`` bits of one block, so a look-up reads one block, by an
equi-join on the block's number. Keys that pass, false positives among them, meet
the list itself in a join on the whole key, which makes the result exact.

The filter has at most ``MOST_BLOCKS`` blocks (16 MB), so it may be broadcast; a
longer list makes it pass more, not answer wrongly. Everything is DataFrame work.

Defined cases: a null URL, or one without ``://``, has an empty host and path,
asks for no rule and is allowed; rules or listed rows with null parts are left
out; a rule given twice counts once, and of two verdicts for one rule ``block``
wins; repeated pages give a row each; empty lists allow everything; only page_id
and url of the pages are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BLOCK_WORDS = 8                 # 64-bit words of a block
PROBES = 4
BITS_PER_KEY = 12
MOST_BLOCKS = 1 << 18
TRACKING = r"(?i)^(?:utm_[a-z]+|ref|fbclid|gclid)(?:=|$)"


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; null without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    """Up to the first of / ? #, A-Z lower-cased."""
    name = F.regexp_extract(rest_of(url), r"^[^/?#]*", 0)
    return F.coalesce(ascii_lower(name), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ? or #."""
    return F.coalesce(F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without a final /, the query without tracking parts, in order; no scheme or fragment."""
    query = F.regexp_extract(rest_of(url), r"^[^?#]*\?([^#]*)", 1)
    parts = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    return F.concat(host, path, F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise(F.lit("")))


# --- the filter -------------------------------------------------------------------

def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bits_of(key: Column) -> list[tuple[Column, Column]]:
    """For each probe the word of its block and the mask of its bit, from one other hash of the key."""
    h = F.xxhash64(F.lit("bits"), key)
    out = []
    for i in range(PROBES):
        bit = F.shiftrightunsigned(h, 9 * i).bitwiseAND(64 * BLOCK_WORDS - 1).cast("int")
        out.append((F.shiftright(bit, 6), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63))))
    return out


def blocked_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """One row per filled block of the filter of ``keys`` (key): its number and its words."""
    probe = F.explode(F.array(*[F.struct(w.alias("word"), m.alias("mask")) for w, m in bits_of(F.col("key"))]))
    words = keys.select(block_of(F.col("key"), blocks).alias("block"), probe.alias("p")).groupBy("block").agg(
        *[F.coalesce(F.bit_or(F.when(F.col("p.word") == i, F.col("p.mask"))), F.lit(0).cast("long")).alias(f"w{i}")
          for i in range(BLOCK_WORDS)])
    return words.select("block", F.array(*[f"w{i}" for i in range(BLOCK_WORDS)]).alias("words"))


def filter_blocks(keys: DataFrame) -> int:
    """Blocks for ``BITS_PER_KEY`` bits a key, at most ``MOST_BLOCKS``."""
    n = keys.count()
    return max(1, min(MOST_BLOCKS, -(-n * BITS_PER_KEY // (64 * BLOCK_WORDS))))


def possible(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """``asked`` (key, ...) with ``maybe``: false where the filter of ``keys`` rules the key out."""
    blocks = filter_blocks(keys)
    # At most MOST_BLOCKS rows of 80 bytes, however long the list.
    held = F.broadcast(blocked_filter(keys, blocks))
    probed = asked.withColumn("block", block_of(F.col("key"), blocks)).join(held, "block", "left")
    every = F.lit(True)
    for word, mask in bits_of(F.col("key")):
        every = every & (F.get(F.col("words"), word).bitwiseAND(mask) != 0)
    return probed.withColumn("maybe", F.coalesce(every, F.lit(False))).drop("block", "words")


# --- verdicts ---------------------------------------------------------------------

def rule_keys(rules: DataFrame) -> DataFrame:
    """One row per rule: its key, name, length and verdict."""
    sound = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
    name = F.concat(F.col("host"), F.col("path"))
    return sound.groupBy(F.concat(F.lit("r:"), F.col("host"), F.lit(" "), F.col("path")).alias("key")).agg(
        F.max(F.struct(F.length(name).alias("n"), F.col("verdict") == "block", name.alias("rule"), F.col("verdict").alias("verdict")))
        .alias("r")).select("key", F.col("r.n").alias("n"), F.col("r.rule").alias("rule"), F.col("r.verdict").alias("listed"))


def url_keys(listed: DataFrame) -> DataFrame:
    """One row per listed canonical URL."""
    return listed.where(F.col("url").isNotNull()).select(F.concat(F.lit("u:"), canonical(F.col("url"))).alias("key")).distinct() \
        .select("key", F.lit(0).alias("n"), F.lit(None).cast("string").alias("rule"), F.lit("block").alias("listed"))


def rule_shape(rules: DataFrame) -> tuple[int, list[int]]:
    """The most labels of a rule's host, and the lengths of the rules' paths (as many as differ, not as many as rules)."""
    labels = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("n")).collect()[0]["n"] or 0
    lengths = rules.where(F.col("path").isNotNull()).select(F.length("path").alias("n")).distinct().collect()
    return labels, sorted(r["n"] for r in lengths)


def asked_keys(host: Column, path: Column, url: Column, labels: int, lengths: list[int]) -> Column:
    """The keys of a page: its canonical URL, and host suffixes with path prefixes."""
    own = F.when(host != "", F.array(F.concat(F.lit("u:"), canonical(url)))).otherwise(F.array().cast("array<string>"))
    if not labels:
        return own
    names = F.split(host, r"\.")
    short = F.slice(names, -F.least(F.size(names), F.lit(labels)), F.lit(labels))
    hosts = F.transform(F.sequence(F.lit(1), F.size(short)), lambda i: F.array_join(F.slice(short, i, F.lit(labels)), "."))
    prefixes = F.array_compact(F.array(*[F.when(F.length(path) >= n, F.left(path, F.lit(n))) for n in lengths]))
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.concat(F.lit("r:"), h, F.lit(" "), p))))
    return F.when(host != "", F.concat(own, pairs)).otherwise(own)


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """Per page: host, path, the longest fitting rule and the verdict.

    ``rules``: host, path, verdict. ``listed``: url. What a URL gets depends on
    the URL alone, so each distinct URL is asked for once.
    """
    labels, lengths = rule_shape(rules)
    table = rule_keys(rules).unionByName(url_keys(listed))
    urls = pages.where(F.col("url").isNotNull()).select("url").distinct()
    asked = urls.select("url", F.explode(asked_keys(host_of(F.col("url")), path_of(F.col("url")), F.col("url"), labels, lengths))
                        .alias("key"))
    hits = possible(asked, table.select("key")).where("maybe").select("url", "key").join(table, "key")
    won = hits.groupBy("url").agg(F.max(F.struct(F.col("n"), F.col("rule"), F.col("listed"))).alias("won"))
    # One row per URL on the right; spread anew, so that a hot URL's pages can be split.
    spread = won.repartition(F.xxhash64("url"))
    return pages.select("page_id", "url").join(spread, "url", "left").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("won.rule").alias("rule"),
        F.coalesce("won.listed", F.lit("allow")).alias("verdict"))
