"""The registered query of every operator: its production parameters over the whole table."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from balancier.llm import (
    contamination, divergence, factors, filters, fingerprints, jaccard, packing, quality, sentences, substrings, token_files,
    vectors, warc,
)
from balancier.llm.common import small_batches
from balancier.session import work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

END = 0  # id put after every document


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    token_files.write(token_files.encode(table(spark, sf_dir, "documents"), path, END), folder)
    return token_files.digests(token_files.read(spark, folder))


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(spark, packing.pieces(table(spark, sf_dir, "documents"), path, END))


@query
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return sentences.digests(sentences.decode(sentences.encode(table(spark, sf_dir, "documents"), path), path))


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark)
    warc.write(warc.records(table(spark, sf_dir, "pages")), folder)
    found = warc.captures(warc.read(spark, folder, payloads=False))
    return found.select(
        "page_id", "response.payload_bytes", "response.payload_digest",
        F.col("response.type").alias("record_type"), F.col("revisit_of").alias("refers_to"),
    )


# SQL can say what the archives must give back: payloads are read as they were stored.
ORACLE["op10_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n FROM pages),
last AS (SELECT body, max(page_id) AS kept FROM p WHERE n >= 1000 GROUP BY body)
SELECT p.page_id, n AS payload_bytes, sha1(p.body) AS payload_digest,
       CASE WHEN kept > p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN kept > p.page_id THEN kept END AS refers_to
FROM p LEFT JOIN last ON last.body = p.body
"""


@query
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(spark, table(spark, sf_dir, "documents"))


@query
def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(spark, table(spark, sf_dir, "documents"))


@query
def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = factors.dedup(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(spark, table(spark, sf_dir, "embeddings"))


@query
def op11_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# The plain way: every step of all 120 orders from the sets of failed filters, and sums over the orders.
ORACLE["op11_filters"] = r"""
WITH d AS (SELECT coalesce(lang, '') AS part, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
f AS (
    SELECT part, doc_id, CASE WHEN len(words) < 100 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS failed
    FROM w),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
h AS (SELECT part, failed, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
      FROM f LEFT JOIN l USING (doc_id) GROUP BY part, failed),
letters AS (SELECT i, substr('ABCDE', i + 1, 1) AS letter, 1 << i AS bit FROM range(5) r(i)),
orders AS (
    SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order,
           [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
    SELECT filter_order, CAST(s AS INT) AS step, bits[s] AS own, CAST(coalesce(list_sum(bits[1:s - 1]), 0) AS INT) AS before
    FROM orders, range(1, 6) r(s)),
done AS (
    SELECT part, filter_order, step, own,
           sum(CASE WHEN failed & (before | own) = 0 THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN failed & before = 0 AND failed & own <> 0 THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN failed & before <> 0 AND failed & own <> 0 THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN failed = own THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN failed & before = 0 AND failed & own <> 0 THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN failed & before = 0 AND failed & own <> 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM h, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM done
"""


@query
def op12_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.digests(contamination.find(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


ORACLE["op12_contamination"] = r"""
WITH pattern AS (SELECT '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' AS word),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), word) AS words FROM documents, pattern),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), word) AS words FROM benchmark, pattern),
windows AS (SELECT DISTINCT item, least(10, len(words)) AS size, words[i:i + least(10, len(words)) - 1] AS win
            FROM b, unnest(range(1, greatest(len(words) - 9, least(1, len(words))) + 1)) u(i)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT r, size, i, words[i:i + size - 1] AS win
           FROM (SELECT r, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM d, sizes WHERE len(words) >= size)),
hits AS (SELECT DISTINCT r, i, size, item FROM places JOIN windows USING (size, win)),
covered AS (SELECT r, count(DISTINCT w) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS w FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS names FROM hits GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""


@query
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(spark, table(spark, sf_dir, "documents"))


# The plain way: every term of every pair, those that neither has among them.
ORACLE["op13_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
c AS (SELECT lang, source, r, term, count(*) AS n FROM (SELECT lang, source, r, unnest(words) AS term FROM d) GROUP BY ALL),
terms AS (SELECT lang, term FROM c GROUP BY lang, term HAVING count(*) >= 3),
v AS (SELECT lang, count(*) AS v FROM terms GROUP BY lang),
counts AS (SELECT lang, source, term, sum(n) AS n FROM c JOIN terms USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM d),
totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN counts USING (lang, source) GROUP BY lang, source),
shares AS (
    SELECT g.lang, g.source, t.term, coalesce(n, 0) AS n,
           CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 1)) // (total + v) AS BIGINT) AS p
    FROM totals g JOIN terms t ON t.lang = g.lang JOIN v ON v.lang = g.lang
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
whole AS (
    SELECT lang, term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + v) AS BIGINT) AS q
    FROM (SELECT lang, term, sum(n) AS n FROM counts GROUP BY lang, term) JOIN v USING (lang)),
pair_terms AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
               FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pair_terms p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
tops AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value
            FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
both_parts AS (SELECT * FROM pairs UNION ALL SELECT * FROM tops),
ranks AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM both_parts)
SELECT lang, source, part, item, value, rank FROM ranks WHERE part = 'pair' OR rank <= 200
"""
