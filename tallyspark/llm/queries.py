"""The queries opN_* over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, mixing, more_queries, ngram_join, pii, quality, sharding, suffix_dedup, token_files, toxicity, url_filters
from .common import read_table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_long_strings(read_table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_classes(read_table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = token_files.write_token_files(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    read = token_files.read_records(token_files.read_index(spark, path), path, "read_tokens bigint, ids_crc32 bigint", token_files.digest)
    return read.select("doc_id", "start", F.col("read_tokens").alias("n_tokens"), "ids_crc32")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(read_table(spark, sf_dir, "documents"), everywhere=True)
    counts = [pii.count_of(F.col("base"), k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(pii.named(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.named(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_ngram_join": op2_ngram_join,
    "op3_url_filters": op3_url_filters,
    "op4_token_files": op4_token_files,
    "op5_personal_data": op5_personal_data,
    "op6_mix_sources": op6_mix_sources,
    "op7_decontaminate": op7_decontaminate,
    "op8_shards": op8_shards,
    "op9_toxicity": op9_toxicity,
    "op10_quality_rules": op10_quality_rules,
    **more_queries.QUERIES,
}

_OP3 = r"""
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rhost, rpath, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
j AS (
  SELECT u.*, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST, length(r.rhost) DESC) AS k
  FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE
         WHEN len(list_intersect(regexp_split_to_array(host, '[.-]'), string_split('ads adserver adservice adclick banner popunder doubleclick track tracker clicktrack bet bets betting bingo casino casinos jackpot lottery poker roulette slots pill pills viagra cialis tramadol xanax porn porno xxx sex escort escorts camgirls spam spammer phishing malware warez cracks keygen torrent torrents', ' '))) > 0 THEN 'block'
         WHEN len(list_intersect(list_transform(string_split(path, '/'), lambda x: string_split(x, '.')[1]), string_split('cart checkout login logout signin signup register wp-admin wp-login xmlrpc cgi-bin basket unsubscribe', ' '))) > 0 THEN 'block'
         WHEN contains(path, '.') AND list_contains(string_split('exe msi apk dmg iso zip rar gz jpg jpeg png gif webp svg ico mp3 mp4 avi mov css js woff', ' '), string_split(path, '.')[-1]) THEN 'block' ELSE 'allow' END) AS verdict
FROM j WHERE k = 1
"""

_OP6 = r"""
WITH s AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS k
  FROM documents),
t AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END AS w
  FROM s GROUP BY source),
o AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / w AS level FROM t),
f AS (
  SELECT *, ((SELECT sum(source_size) FROM t)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / ((SELECT sum(w) FROM t) - coalesce(sum(w) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) AS share
  FROM o),
l AS (SELECT arg_min(share, (level, source)) AS lam FROM f WHERE level >= share),
g AS (
  SELECT source, source_size, CASE WHEN level >= share THEN lam * w ELSE cap END AS target FROM f, l),
h AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM g),
p AS (
  SELECT s.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM s)
SELECT p.doc_id, p.size, h.source_size, h.target,
       (h.whole * p.size + greatest(0, least(p.size, round(h.target - h.whole * h.source_size)::BIGINT - p.before)))::BIGINT AS taken
FROM p JOIN h ON p.source IS NOT DISTINCT FROM h.source
"""

_OP7 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
x AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
m AS (SELECT x.doc_id, x.i, x.n, g.item FROM x JOIN g USING (n, gram)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
q AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN q USING (doc_id)
"""

_OP8 = r"""
WITH RECURSIVE r AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         substr(md5(coalesce(doc_id::VARCHAR, 'null') || chr(0) || md5(coalesce(text, ''))), 1, 15) AS x FROM documents),
h AS (
  SELECT doc_id, n_bytes, list_aggregate(list_transform(string_split(x, ''), lambda c: lpad(bin(('0x' || c)::INT), 4, '0')), 'string_agg', '') AS h FROM r),
n AS (
  SELECT substr(h, 1, d) AS prefix, d, sum(n_bytes)::BIGINT AS bytes, count(*) AS rows FROM h, range(0, 61) AS t(d) GROUP BY ALL),
o AS (
  SELECT '' AS prefix, 0 AS d, (SELECT bytes FROM n WHERE d = 0) AS bytes, (SELECT rows FROM n WHERE d = 0) AS rows
  UNION ALL
  SELECT n.prefix, n.d::INTEGER, n.bytes, n.rows FROM o JOIN n ON n.d = o.d + 1 AND substr(n.prefix, 1, o.d) = o.prefix
  WHERE o.bytes > 1048576 AND o.rows > 1),
s AS (SELECT * FROM o WHERE bytes <= 1048576 OR rows = 1 OR d = 60)
SELECT h.doc_id, h.n_bytes, s.prefix AS shard, s.d AS depth, s.bytes AS shard_bytes, s.rows AS shard_docs
FROM h JOIN s ON starts_with(h.h, s.prefix)
"""

_OP2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, m) AS (
  SELECT doc_id, doc_id FROM w
  UNION
  SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.m)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""

ORACLE = {"op2_ngram_join": _OP2, "op3_url_filters": _OP3, "op6_mix_sources": _OP6, "op7_decontaminate": _OP7, "op8_shards": _OP8, **more_queries.ORACLE}
