"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from annotrail.llm import (
    decontaminate,
    language_id,
    line_dedup,
    mixing,
    near_dup,
    quality_classifier,
    quality_rules,
    suffix_dedup,
    toxicity,
    warc_audit,
)
from annotrail.llm.common import table


def op1_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.scored(table(spark, sf_dir, "documents"))


def op2_suffix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op3_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op4_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op5_site_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op6_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_audit.report(table(spark, sf_dir, "pages"))


def op7_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.report(table(spark, sf_dir, "documents"))


def op8_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_evidence_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_weak_label_quality,
        op2_suffix_doubling,
        op3_compression_bands,
        op4_pareto_mix,
        op5_site_frequency,
        op6_merkle_audit,
        op7_probminhash,
        op8_suffix_automaton,
        op9_counterfactual_toxicity,
        op10_evidence_fusion,
    )
}

ORACLE: dict[str, str] = {
    "op4_pareto_mix": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         (CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 13) AS BIGINT)
          + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s
), lev AS (SELECT arg_min(level, 2 * source_size / weight) AS level FROM l WHERE level <= 2 * source_size / weight),
t AS (
  SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), lev.level * weight) AS target FROM s, lev
), r AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(least(floor(target / source_size), 2) AS BIGINT) END AS base FROM t
), k0 AS (
  SELECT source, size, target - base * source_size AS rest, count(*) * size AS words
  FROM d JOIN r USING (source) WHERE size > 0 GROUP BY source, size, target, base, source_size
  UNION ALL
  SELECT NULL, size, target - base * source_size, count(*) * size
  FROM d, r WHERE d.source IS NULL AND r.source IS NULL AND size > 0 GROUP BY size, target, base, source_size
), k1 AS (
  SELECT source, size, rest - coalesce(sum(words) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
         sum(CAST(round(sqrt(CAST(size AS DOUBLE)) * 1024) AS BIGINT) * words) OVER (PARTITION BY source ORDER BY size) AS pull
  FROM k0
), k2 AS (
  SELECT source, arg_max(lft * 1024 / pull, size) AS k, max(size) AS largest, arg_max(lft, size) AS lft
  FROM k1 WHERE lft * 1024 / pull * sqrt(CAST(size AS DOUBLE)) < 1 GROUP BY source
), e AS (
  SELECT doc_id, d.source, size, u, source_size, target, base,
         CASE WHEN target - base * source_size > 0 THEN coalesce(k, 1.0) ELSE 0.0 END AS k,
         coalesce(largest, 0) AS largest, coalesce(lft, 0) AS lft
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN k2 ON r.source IS NOT DISTINCT FROM k2.source
), o AS (
  SELECT *, CASE WHEN size > 0 AND size <= largest AND k > 0
                 THEN (u / (1 - u)) / (k * sqrt(CAST(size AS DOUBLE)) / (1 - k * sqrt(CAST(size AS DOUBLE)))) END AS odds
  FROM e
), v AS (SELECT *, odds / (1 + odds) AS rnk FROM o), w AS (
  SELECT *, sum(size) OVER (PARTITION BY source, rnk) AS tie, sum(size) OVER (PARTITION BY source, rnk IS NULL ORDER BY rnk) AS upto FROM v
), c AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE least(2, base + CASE WHEN rnk IS NULL THEN CAST(size > largest AND k > 0 AS INT)
                                                                ELSE CAST(upto - tie + tie / 2 <= lft AS INT) END) END AS copies
  FROM w
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM c
""",
    "op5_site_frequency": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
p AS (SELECT DISTINCT coalesce('=' || source, '') AS h, text FROM d WHERE text IS NOT NULL),
l AS (SELECT h, text, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')))) AS line FROM p),
n AS (SELECT h, line, count(*) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY h, line),
t AS (SELECT h, count(*) AS pages FROM p GROUP BY h),
b AS (SELECT h, line FROM n JOIN t USING (h) WHERE n >= 5 AND n > pages * 0.1),
s AS (SELECT h, list(line) AS drops FROM b GROUP BY h),
k AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS ls,
         list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(drops, []), trim(x, ' '))) AS kept
  FROM d LEFT JOIN s ON coalesce('=' || d.source, '') = s.h
)
SELECT doc_id, source, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(ls) - len(kept), 0) AS BIGINT) AS n_dropped,
       CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text
FROM k
""",
    "op6_merkle_audit": r"""
WITH p AS (
  SELECT page_id, url, html, substr(md5(url), 1, 2) AS fault FROM pages
), r AS (
  SELECT page_id, url, html, html AS b, false AS lost FROM p WHERE false
  UNION ALL
  SELECT page_id, url, html,
         CASE fault WHEN '00' THEN '?' || substr(html, 2) WHEN '01' THEN substr(html, 1, length(html) // 2) ELSE html END,
         coalesce(fault = '02', false)
  FROM p
), w AS (
  SELECT page_id, lost, 'WARC/1.0' || crlf || 'WARC-Type: resource' || crlf || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), 'none') || '>' || crlf
         || coalesce('WARC-Target-URI: ' || url || crlf, '') || 'Content-Type: text/html' || crlf || 'Content-Length: ' AS head,
         coalesce(html, '') AS a, coalesce(b, '') AS b, crlf || crlf AS gap
  FROM r, (SELECT chr(13) || chr(10) AS crlf)
), d AS (
  SELECT page_id, lost, head || strlen(a) || gap || a || gap AS x, head || strlen(b) || gap || b || gap AS y FROM w
), m AS (
  SELECT page_id, strlen(x) AS length, sha256(x) AS digest, count(*) AS copies, bool_or(lost) AS lost, bool_and(sha256(x) = sha256(y)) AS same
  FROM d GROUP BY page_id, x
), n AS (SELECT *, coalesce(page_id - (SELECT min(page_id) FROM pages) + 4096, 0) AS number FROM m)
SELECT page_id, CAST(number // 4096 AS BIGINT) AS file,
       CAST(coalesce(sum(length * copies) OVER (PARTITION BY number // 4096 ORDER BY number, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset,
       CAST(length AS BIGINT) AS length, digest, CAST(copies AS BIGINT) AS copies,
       CASE WHEN lost THEN 'missing' WHEN same THEN 'intact' ELSE 'altered' END AS status
FROM n
""",
    "op8_suffix_automaton": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[k : k + least(len(ws), 10) - 1], ' ') AS w
  FROM i, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS t(k) WHERE len(ws) > 0
), lens AS (SELECT DISTINCT n FROM win), pos AS (
  SELECT r, k, n, array_to_string(ws[k : k + n - 1], ' ') AS w
  FROM d, lens, unnest(range(1, len(ws) - n + 2)) AS t(k)
), hit AS (
  SELECT r, k, pos.n, item FROM pos JOIN win ON pos.w = win.w AND pos.n = win.n
), covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM hit, unnest(range(k, k + n)) AS t(p) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT r, item FROM hit WHERE item IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
""",
}
