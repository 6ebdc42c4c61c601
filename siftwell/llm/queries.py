"""The registered queries of the operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftwell.llm import exact_dedup, licenses, mixing, packing, quality_knn, quality_rules, simhash, token_counts, toxicity, url_rules
from siftwell.llm.common import table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), VOCABULARY)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), VOCABULARY)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), digest_all=True)


def op6_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH hashed AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), grouped AS (
  SELECT text_sha256, min(doc_id) AS least_id, count(*) AS group_size FROM hashed GROUP BY text_sha256
)
SELECT h.doc_id, coalesce(g.least_id, h.doc_id) AS keep_id, CAST(g.group_size AS BIGINT) AS group_size,
       coalesce(g.least_id, h.doc_id) IS NOT DISTINCT FROM h.doc_id AS kept, h.text_sha256
FROM hashed h JOIN grouped g ON h.text_sha256 = g.text_sha256
"""


#: Weights by the square root of a source's documents, in units of 2^-28; earliest deadline first, slot by slot.
OP3_SQL = """
WITH RECURSIVE numbered AS (
  SELECT doc_id, coalesce(source, '') AS source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents
), counts AS (SELECT source, count(*) AS n, CAST(round(sqrt(count(*)) * 1000000) AS HUGEINT) AS raw FROM numbered GROUP BY source),
units AS (
  SELECT source, greatest(1, CAST((raw * 268435456) // (SELECT sum(raw) FROM counts) AS BIGINT)) AS w, (n + 7) // 8 AS blocks, row_number() OVER (ORDER BY source) AS idx FROM counts
), lists AS (
  SELECT list(w ORDER BY idx) AS a, CAST(sum(w) AS BIGINT) AS total FROM units
), last AS (SELECT max((blocks * total + w - 1) // w) AS slots FROM units, lists),
edf AS (
  SELECT CAST(-1 AS BIGINT) AS t, CAST(0 AS BIGINT) AS pick, list_transform(a, lambda x: CAST(0 AS BIGINT)) AS done FROM lists
  UNION ALL
  SELECT t + 1, next, list_transform(done, lambda x, i: CASE WHEN i = next THEN x + 1 ELSE x END)
  FROM (SELECT t, done, CAST(list_position(due, list_min(due)) AS BIGINT) AS next FROM (
    SELECT t, done, list_transform(done, lambda x, i: CASE WHEN (x * total) // a[i] <= t + 1 THEN ((x + 1) * total + a[i] - 1) // a[i] ELSE 9000000000000000000 END) AS due
    FROM edf, lists, last WHERE t < slots))
), planned AS (SELECT pick AS idx, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS k FROM edf WHERE t >= 0),
ranked AS (SELECT n.doc_id, n.source, u.w, u.idx, row_number() OVER (PARTITION BY n.source ORDER BY place, doc_id) - 1 AS rank FROM numbered n JOIN units u ON u.source = n.source)
SELECT b.doc_id, b.source, b.rank // 8 AS block, p.slot, (p.k * total) // b.w AS release, ((p.k + 1) * total + b.w - 1) // b.w AS deadline, p.slot * 8 + b.rank % 8 AS position
FROM ranked b JOIN planned p ON p.idx = b.idx AND p.k = b.rank // 8 CROSS JOIN lists
"""


#: Host, path and fixed rules; tokens; all combinations of up to three tokens of the URLs that a fixed rule judges, with
#: their counts by label; what support, confidence and shorter rules leave; and the best that fits.
OP7_SQL = r"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages
), fixed(what, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
judged AS (
  SELECT u.*, (SELECT max_by(h || p, length(h || p)) FROM fixed WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
    (SELECT max_by(what, length(h || p)) FROM fixed WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS fixed_verdict,
    string_split(host, '.') AS labels, list_filter(string_split_regex(host, '[.\-]'), lambda x: x <> '') AS words, split_part(path, '/', 2) AS first FROM parts u
), tokens AS (
  SELECT *, row_number() OVER () AS n, CASE WHEN host = '' THEN [] ELSE list_distinct(list_concat(
      ['d:' || labels[-1], 'd:' || array_to_string(labels[greatest(1, len(labels) - 1):], '.')], list_transform(words[:greatest(len(words) - 2, 0)], lambda x: 'w:' || x),
      CASE WHEN first <> '' AND NOT regexp_matches(first, '^[0-9]+(\.\w+)?$') THEN ['p:' || first] ELSE [] END)) END AS t FROM judged
), each AS (SELECT n, fixed_verdict AS label, unnest(t) AS x FROM tokens WHERE fixed_verdict IS NOT NULL),
general AS (
  SELECT * FROM each WHERE x NOT IN (SELECT 'w:' || unnest(string_split_regex(h, '[.\-]')) FROM fixed) AND x NOT IN (SELECT 'p:' || split_part(p, '/', 2) FROM fixed WHERE p <> '/')
    AND NOT (starts_with(x, 'd:') AND EXISTS (SELECT 1 FROM fixed WHERE ends_with('.' || substr(x, 3), '.' || h) OR ends_with('.' || h, '.' || substr(x, 3))))
), sets AS (
  SELECT n, label, [x] AS antecedent FROM general
  UNION ALL SELECT a.n, a.label, [a.x, b.x] FROM general a JOIN general b ON a.n = b.n AND a.x < b.x
  UNION ALL SELECT a.n, a.label, [a.x, b.x, c.x] FROM general a JOIN general b ON a.n = b.n AND a.x < b.x JOIN general c ON c.n = b.n AND b.x < c.x
), counts AS (SELECT antecedent, label, count(*) AS support, sum(count(*)) OVER (PARTITION BY antecedent) AS every FROM sets GROUP BY antecedent, label),
sure AS (
  SELECT antecedent, label AS mined_verdict, support, CAST(support AS DOUBLE) / CAST(every AS DOUBLE) AS confidence FROM counts
  WHERE support >= ceil(0.002e0 * (SELECT count(*) FROM tokens WHERE fixed_verdict IS NOT NULL)) AND CAST(support AS DOUBLE) / CAST(every AS DOUBLE) >= 0.9e0
), mined AS (
  SELECT * FROM sure r WHERE NOT EXISTS (SELECT 1 FROM sure s WHERE s.mined_verdict = r.mined_verdict AND len(s.antecedent) = len(r.antecedent) - 1 AND list_has_all(r.antecedent, s.antecedent) AND s.confidence >= r.confidence)
), hits AS (
  SELECT k.n, m.*, array_to_string(m.antecedent, ' ') AS mined_rule FROM tokens k JOIN mined m ON list_has_all(k.t, m.antecedent)
), best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY n ORDER BY confidence DESC, len(antecedent) DESC, mined_verdict = 'block' DESC, support DESC, mined_rule DESC) = 1)
SELECT k.page_id, k.host, k.path, k.rule, coalesce(k.fixed_verdict, b.mined_verdict, 'allow') AS verdict, b.mined_rule, b.confidence FROM tokens k LEFT JOIN best b ON b.n = k.n
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_toxicity, op2_best_fit_packing, op3_mix_sources, op4_token_counts, op5_exact_dedup, op6_quality_knn, op7_url_rules, op8_license_scan, op9_quality_rules, op10_simhash_near_dedup)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_mix_sources": OP3_SQL, "op5_exact_dedup": OP5_SQL, "op7_url_rules": OP7_SQL}
