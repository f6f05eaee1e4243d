"""The named queries of this folder, each with the SQL that checks it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelrules.llm import (bloom_lm, common as c, debruijn, decontaminate, divergence, hard_negatives, kd_shards, order_minhash, packing,
                             pca_clusters, secret_cnn, suffix_dedup, url_filter, warc)
from parcelrules.plans.registry import rounded
from parcelrules.session import work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECK_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            CHECK_SQL[name] = sql
        return fn

    return register


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_bloom_lm")
def bloom_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return bloom_lm.score_table(c.table(spark, folder, "documents"))


# For the SQL of the queries: A-Z lower-cased, and the words of a text.
LOWER = "translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PLAIN_WORDS = f"regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query("op3_decontaminate", f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {PLAIN_WORDS.format(text='text')} AS w FROM documents),
    i AS (SELECT item_id, {PLAIN_WORDS.format(text='text')} AS w FROM benchmark),
    windows AS (SELECT DISTINCT item_id, m, array_to_string(w[a:a + m - 1], ' ') AS words FROM (
        SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS a FROM i WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT m FROM windows),
    places AS (SELECT rid, m, a, array_to_string(w[a:a + m - 1], ' ') AS words FROM (
        SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS a FROM d, sizes WHERE len(w) >= m)),
    found AS (SELECT rid, a, m, item_id FROM places JOIN windows USING (m, words)),
    hits AS (SELECT rid, count(DISTINCT word) AS n_hit FROM (SELECT rid, unnest(range(a, a + m)) AS word FROM found) GROUP BY rid),
    items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
              FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY rid)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hits USING (rid) LEFT JOIN items USING (rid)""")
def contamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(c.table(spark, folder, "documents"), c.table(spark, folder, "benchmark"))


@query("op6_pack")
def packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.digest(packing.pack(c.table(spark, folder, "documents"), tokenizer_path()))


NOT_SPACE = "[^\\x20\\x09-\\x0D]"
CHAR_BINS = ", ".join(f"struct_pack(bin := {i}, n := length(regexp_replace(t, '{p.replace(chr(39), chr(39) * 2)}', '', 'g')))"
                      for i, p in enumerate(divergence.CLASSES.values()))
WORD_BINS = ", ".join(f"('{lang}', {i}, '{name}')" for lang, names in divergence.COMMON.items() for i, name in enumerate(names))


@query("op8_divergence", f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t,
                      regexp_extract_all(coalesce(text, ''), '{NOT_SPACE}+') AS w FROM documents),
    windows AS (SELECT rid, a, array_to_string(w[a:a + 2], ' ') AS words FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS a FROM d)),
    twice AS (SELECT rid, a, count(*) OVER (PARTITION BY rid, words) AS n FROM windows),
    repeated AS (SELECT rid, count(DISTINCT word) AS n FROM (SELECT rid, unnest([a, a + 1, a + 2]) AS word FROM twice WHERE n > 1) GROUP BY rid),
    m AS (SELECT d.*, len(w) AS n_words, coalesce(r.n, 0) AS n_repeat_words,
                 list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{NOT_SPACE}')) AS lines FROM d LEFT JOIN repeated r USING (rid)),
    listed AS (SELECT * FROM (VALUES {WORD_BINS}) x(lang, bin, name)),
    said AS (SELECT rid, lower(word) AS name, count(*) AS n FROM (SELECT rid, unnest(w) AS word FROM d) GROUP BY 1, 2),
    char_counts AS (SELECT rid, lang, x.bin, x.n FROM (SELECT rid, lang, t, unnest([{CHAR_BINS}]) AS x FROM d)),
    common_counts AS (SELECT d.rid, d.lang, l.bin, coalesce(s.n, 0) AS n FROM d JOIN listed l USING (lang) LEFT JOIN said s ON s.rid = d.rid AND s.name = l.name),
    counts AS (
        SELECT 'chars' AS kind, rid, lang, bin, n FROM char_counts
        UNION ALL SELECT 'chars', rid, any_value(c.lang), {len(divergence.CLASSES)}, any_value(length(t)) - sum(n) FROM char_counts c JOIN d USING (rid) GROUP BY rid
        UNION ALL SELECT 'words', rid, lang, bin, n FROM common_counts
        UNION ALL SELECT 'words', rid, any_value(c.lang), {divergence.BINS}, any_value(len(w)) - sum(n) FROM common_counts c JOIN d USING (rid) GROUP BY rid),
    shares AS (SELECT kind, rid, lang, bin, n / nullif(sum(n) OVER (PARTITION BY kind, rid), 0) AS p FROM counts),
    reference AS (SELECT kind, s.lang, bin, avg(p) AS q FROM shares s JOIN m USING (rid)
                  WHERE n_words >= {divergence.LEAST_WORDS} AND s.lang IN (SELECT lang FROM listed) GROUP BY ALL),
    distance AS (SELECT rid, kind, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
                        + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS far
                 FROM shares JOIN reference USING (kind, lang, bin) WHERE p IS NOT NULL GROUP BY rid, kind),
    judged AS (SELECT m.*, c.far AS char_far, v.far AS word_far, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
               FROM m LEFT JOIN distance c ON c.rid = m.rid AND c.kind = 'chars' LEFT JOIN distance v ON v.rid = m.rid AND v.kind = 'words')
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
           CAST(length(t) - length(translate(t, '{divergence.SYMBOLS}', '')) AS BIGINT) AS n_symbols,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
           NOT base_failed AND NOT coalesce(char_far > {divergence.MOST_CHARS}, FALSE)
               AND NOT (n_words >= {divergence.LEAST_COMMON} AND coalesce(word_far > {divergence.MOST_WORDS}, FALSE)) AS kept,
           round(char_far, 6) AS char_distance, round(word_far, 6) AS word_distance
    FROM judged""")
def quality(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(divergence.quality(c.table(spark, folder, "documents")), 6)


# The rules of the query, as SQL that both engines read.
RULES = """SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
    ('org', '/fr/', 'allow')) AS rules(host, path, verdict)"""
# A page's URL is on the list if its host has a name of this form.
LISTED = "(^|[.])(spam|cheap-pills|casino|adult|malware)[a-z-]*[.]"


@query("op10_url_filter", f"""
    WITH rules AS ({RULES}), parts AS (
        SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
    ), split AS (
        SELECT page_id, url, rest, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
    ), named AS (
        SELECT *, regexp_replace(host, '^www[.]', '') || regexp_replace(path, '/+$', '') || coalesce('?' || nullif(array_to_string(
               list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1), '&'),
               lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)', 'i'))), '&'), ''), '') AS canonical
        FROM split
    ), listed AS (
        SELECT DISTINCT canonical FROM named WHERE regexp_matches(host, '{LISTED}')
    ), fitting AS (
        SELECT DISTINCT n.host, n.path, r.host || r.path AS rule, r.verdict FROM (SELECT DISTINCT host, path FROM named) n JOIN rules r
        ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path)
    ), best AS (
        SELECT host, path, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict FROM fitting GROUP BY host, path
    )
    SELECT n.page_id, n.host, n.path, b.rule,
           coalesce(b.verdict, CASE WHEN n.host <> '' AND l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
    FROM named n LEFT JOIN best b USING (host, path) LEFT JOIN listed l USING (canonical)""")
def url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    pages = c.table(spark, folder, "pages")
    listed = pages.where(url_filter.host_of(F.col("url")).rlike(LISTED)).select("url")
    return url_filter.judge(pages, spark.sql(RULES), listed)


@query("op4_order_minhash")
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.classes(c.table(spark, folder, "documents"))


@query("op7_kd_shards")
def shards(spark: SparkSession, folder: str) -> DataFrame:
    return kd_shards.shard(c.table(spark, folder, "documents"))


@query("op5_warc", """
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
    f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
    SELECT page_id, n AS payload_bytes, digest AS payload_digest,
           CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM p LEFT JOIN f USING (digest)""")
def archived(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(c.table(spark, folder, "pages"), work_folder(spark, "warc"))


@query("op9_secret_cnn")
def secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_cnn.report(c.table(spark, folder, "documents"))


@query("op2_suffix_dedup")
def deduplicated(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.dedup(c.table(spark, folder, "documents")).drop("spans")


@query("op11_hard_negatives", f"""
    WITH e AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), pairs AS (
        SELECT a.vec_id AS anchor_id, x.vec_id AS other_id, a.label = x.label AS same, a.vec_id = x.vec_id AS own,
               CAST(list_sum(list_transform(list_zip(a.q, x.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
        FROM e a, e x WHERE a.vec_id % {hard_negatives.EVERY} = 0
    ), positives AS (
        SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same AND NOT own
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {hard_negatives.POSITIVES}
    )
    SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN pairs USING (anchor_id)
    WHERE NOT same AND {hard_negatives.LOW} * positive_score <= 100 * score AND 100 * score <= {hard_negatives.HIGH} * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
    QUALIFY row_number() OVER w <= {hard_negatives.NEGATIVES}""")
def mined(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.hard_negatives(c.table(spark, folder, "embeddings"))


def cluster_rounds() -> str:
    """Assignment and means, once per round, and the assignment that follows."""
    steps = ["c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), vec_id) - 1 AS number, q FROM v "
             f"QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id), vec_id) <= {pca_clusters.CLUSTERS})"]
    far = "CAST(list_sum(list_transform(list_zip(v.q, m.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    for i in range(pca_clusters.ROUNDS + 1):
        steps.append(f"far{i} AS (SELECT rid, v.q, number, {far} AS distance FROM v, c{i} m), "
                     f"a{i} AS (SELECT * FROM far{i} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, number) = 1)")
        if i < pca_clusters.ROUNDS:
            steps.append(f"""s{i} AS (SELECT number, place, sum(x) AS s, count(*) AS n FROM (SELECT number, unnest(q) AS x, unnest(range(1, len(q) + 1)) AS place FROM a{i})
                GROUP BY number, place),
                m{i} AS (SELECT number, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS q FROM s{i} GROUP BY number),
                c{i + 1} AS (SELECT number, coalesce(m{i}.q, c{i}.q) AS q FROM c{i} LEFT JOIN m{i} USING (number))""")
    return ", ".join(steps)


@query("op13_pca_clusters", f"""
    WITH v AS (
        SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
        FROM embeddings WHERE len(embedding) = {pca_clusters.SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), {cluster_rounds()}
    SELECT vec_id, CAST(number AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY number) AS BIGINT) AS cluster_inertia,
           CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.q, ',')) AS centroid_sha256
    FROM a{pca_clusters.ROUNDS} JOIN v USING (rid) JOIN c{pca_clusters.ROUNDS} m USING (number)""")
def clustered(spark: SparkSession, folder: str) -> DataFrame:
    return pca_clusters.clusters(c.table(spark, folder, "embeddings"))


@query("op12_debruijn_dedup", f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{NOT_SPACE}+') AS w FROM documents),
    windows AS (SELECT rid, a, md5(array_to_string(w[a:a + {debruijn.WINDOW - 1}], ' ')) AS words
                FROM (SELECT rid, w, unnest(range(1, len(w) - {debruijn.WINDOW} + 2)) AS a FROM d WHERE len(w) >= {debruijn.WINDOW})),
    again AS (SELECT rid, a FROM windows JOIN (SELECT words FROM windows GROUP BY words HAVING count(*) > 1) USING (words)),
    words AS (SELECT rid, doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
    marked AS (SELECT words.rid, word, i, i - a < {debruijn.WINDOW} AS gone FROM words ASOF LEFT JOIN again ON words.rid = again.rid AND words.i >= again.a),
    kept AS (SELECT rid, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone IS NOT TRUE) AS text FROM marked GROUP BY rid)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (rid)""")
def without_repeated_windows(spark: SparkSession, folder: str) -> DataFrame:
    return debruijn.dedup(c.table(spark, folder, "documents")).drop("n_spans")
