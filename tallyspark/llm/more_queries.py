"""The queries op11 to op13 over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, fill_middle, secret_scan
from .common import read_table
from .spans import count_in


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(read_table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(read_table(spark, sf_dir, "documents"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secrets(read_table(spark, sf_dir, "documents"))
    counts = [count_in(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(("assign", "access", "hex"))]
    base, spans = secret_scan.named(F.col("base")), secret_scan.named(F.col("spans"))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))


QUERIES = {"op11_fill_in_middle": op11_fill_in_middle, "op12_source_divergence": op12_source_divergence, "op13_secret_scan": op13_secret_scan}

_OP11 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w FROM documents),
c AS (
  SELECT *, len(w)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(w) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(w) + 1) AS b,
         t <> '' AND NOT regexp_matches(t, '<[PSM]>') AND ('0x' || substr(h, 17, 8))::BIGINT % 100 < 90 AS done, ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 AS spm FROM d),
k AS (
  SELECT *, length(array_to_string(w[1:least(a, b)], '')) AS i, length(array_to_string(w[1:greatest(a, b)], '')) AS j FROM c),
p AS (
  SELECT doc_id, n, done, spm, t, i, j, CASE WHEN NOT done THEN t WHEN spm THEN '<S>' || t[j + 1:] || '<P>' || t[1:i] || '<M>' || t[i + 1:j] ELSE '<P>' || t[1:i] || '<S>' || t[j + 1:] || '<M>' || t[i + 1:j] END AS o FROM k)
SELECT doc_id, n, CASE WHEN NOT done THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN done THEN i END AS prefix_chars, CASE WHEN done THEN j - i END AS middle_chars, sha256(o) AS output_sha256,
       sha256(CASE WHEN NOT done THEN o
                   WHEN spm THEN regexp_replace(o, '(?s)^<S>(.*)<P>(.*)<M>(.*)$', '\2\3\1')
                   ELSE regexp_replace(o, '(?s)^<P>(.*)<S>(.*)<M>(.*)$', '\1\3\2') END) AS restored_sha256
FROM p
"""

_OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
v AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
gl AS (SELECT lang, NULL AS source FROM d GROUP BY lang),
n AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN v USING (lang, term) GROUP BY ALL),
c AS (
  SELECT g.lang, g.source, v.term, coalesce(n.n, 0)::HUGEINT AS n FROM g JOIN v USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = v.term
  UNION ALL
  SELECT v.lang, NULL, v.term, sum(n.n)::HUGEINT FROM v JOIN n ON n.lang = v.lang AND n.term = v.term GROUP BY ALL),
p AS (
  SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // (sum(n) OVER w + 5 * count(*) OVER w)::HUGEINT AS p FROM c WINDOW w AS (PARTITION BY lang, source)),
x AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
f AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g JOIN g AS h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN x ON x.lang = g.lang AND x.source = g.source AND x.item = h.source
  UNION ALL
  SELECT a.lang, a.source, 'term', a.term, (a.p - b.p)::BIGINT FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND b.source IS NULL
  WHERE a.source IS NOT NULL AND a.n > 0 AND a.p > b.p),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM k WHERE part = 'pair' OR rank <= 50
"""

_OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
pat(sort, pattern) AS (VALUES
  ('assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  ('access', 'AKIA[A-Z0-9]+'), ('hex', '[0-9a-f]{24,}'), ('blank', '\n[\x20\t\r]*\n'),
  ('named', '[A-Za-z][A-Za-z0-9_.-]{1,40}["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9@+/_.:=-]{3,}'),
  ('address', '[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x00-\x20"''<>]+|[A-Za-z0-9][A-Za-z0-9.-]{2,253}:[0-9]{2,5}'),
  ('token', '[A-Za-z0-9+/_-]{16,}={0,2}')),
m AS (SELECT r, sort, regexp_extract_all(t, pattern) AS m, string_split_regex(t, pattern) AS p FROM d, pat),
s AS (
  SELECT r, sort, m[i] AS v, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m)),
k AS (
  SELECT r, a, a + length(v) AS b, v, sort, CASE
    WHEN sort = 'assign' AND length(regexp_replace(v, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?', '')) >= 6 THEN 0
    WHEN sort = 'access' AND length(v) >= 20 THEN 1
    WHEN sort = 'hex' AND length(v) >= 24 THEN 2
    WHEN sort = 'blank' THEN 9
    WHEN sort = 'named' THEN CASE
      WHEN regexp_matches(lower(regexp_extract(v, '^[A-Za-z0-9_.-]+')), '(user(_?(name|id))?|login|account(_?(id|name))?|client_?id|key_?id|tenant_?id)$') THEN 3
      WHEN regexp_matches(lower(regexp_extract(v, '^[A-Za-z0-9_.-]+')), '(pass(word|wd|phrase|code)?|pwd|secret|token|key|credentials?|auth|bearer)$') THEN 4
      WHEN regexp_matches(lower(regexp_extract(v, '^[A-Za-z0-9_.-]+')), '(host(name)?|server|endpoint|url|uri|dsn)$') THEN 5 END
    WHEN sort = 'address' AND contains(v, '.') THEN 5
    WHEN sort = 'token' AND regexp_matches(v, '[0-9]') THEN CASE
      WHEN regexp_matches(v, '^[A-Z0-9]+$') AND regexp_matches(v, '[A-Z]') THEN 3
      WHEN regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') THEN 4
      WHEN regexp_matches(v, '^[0-9a-f]+$') AND regexp_matches(v, '[a-f]') THEN 4 END END AS kind FROM s),
l AS (SELECT r, a, b, kind, CASE sort WHEN 'named' THEN 1 WHEN 'address' THEN 2 WHEN 'token' THEN 3 WHEN 'blank' THEN 9 ELSE 0 END AS lv FROM k WHERE kind IS NOT NULL),
c AS (
  SELECT x.r, x.a, x.b, x.kind, x.lv, (SELECT count(*) FROM l AS y WHERE y.r = x.r AND y.lv = 9 AND y.a < x.a) AS scope FROM l AS x
  WHERE x.lv < 9 AND NOT EXISTS (SELECT 1 FROM l AS y WHERE y.r = x.r AND y.lv < x.lv AND y.a < x.b AND x.a < y.b)),
n AS (
  SELECT x.r, x.a, x.kind, bool_or(y.kind = 1) AS sid, bool_or(y.kind IN (0, 2)) AS skey, bool_or(y.kind IN (1, 3)) AS id, bool_or(y.kind IN (0, 2, 4)) AS ky, bool_or(y.kind = 5) AS en
  FROM c AS x JOIN c AS y ON x.r = y.r AND x.scope = y.scope AND y.a - x.b <= 300 AND x.a - y.b <= 300 AND (x.a <> y.a OR x.kind <> y.kind) GROUP BY ALL),
z AS (
  SELECT c.r, c.a, c.b, c.kind FROM c LEFT JOIN n ON n.r = c.r AND n.a = c.a AND n.kind = c.kind
  WHERE c.kind < 3 OR (c.kind = 3 AND (skey OR (ky AND en))) OR (c.kind = 4 AND (sid OR (id AND en))) OR (c.kind = 5 AND id AND ky)),
t AS (SELECT *, ['assign', 'access', 'hex', 'id', 'key', 'endpoint'][kind + 1] || ':' || a || ':' || b AS name FROM z),
q AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(name, ',' ORDER BY a, kind) FILTER (kind < 3) AS base, string_agg(name, ',' ORDER BY a, kind) AS spans FROM t GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN q USING (r)
"""

ORACLE = {"op11_fill_in_middle": _OP11, "op12_source_divergence": _OP12, "op13_secret_scan": _OP13}
