"""One query per operator of this subpackage, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, line_dedup, ngram_join, packing, quality_rules, resampling, secret_scan, sharding, suffix_dedup, url_filter
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.report(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: f for name, f in sorted(globals().items(), key=lambda x: (len(x[0].split("_")[0]), x[0])) if name.startswith("op") and callable(f)}


ORACLE_SQL: dict[str, str] = {
    "op3_url_filter": r"""
WITH seen AS (
  SELECT page_id, row_number() OVER () AS n,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(rule, verdict) AS (VALUES ('com/en/', 'block'), ('example.com/en/7', 'allow'), ('net/de/', 'allow'), ('example.net/de/8', 'block'), ('org/es/', 'block')),
cut AS (SELECT rule, verdict, split_part(rule, '/', 1) AS rule_host, substr(rule, length(split_part(rule, '/', 1)) + 1) AS rule_path FROM rules)
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, coalesce(arg_max(verdict, length(rule)), 'allow') AS verdict
FROM (SELECT s.*, c.rule, c.verdict FROM seen s LEFT JOIN cut c
  ON (s.host = c.rule_host OR ends_with(s.host, '.' || c.rule_host)) AND starts_with(s.path, c.rule_path))
GROUP BY n, page_id, host, path""",
    "op2_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
chunks AS (SELECT doc_id, length(h) // 2 - 49 - 100 * k AS n, 100 * k AS base, substr(h, 200 * k + 1, 300) AS c FROM (SELECT doc_id, h, unnest(range(0, (length(h) // 2 - 49 + 99) // 100)) AS k FROM d)),
windows AS (SELECT doc_id, base + i AS p, hash(substr(c, 2 * i + 1, 100)) AS s FROM (SELECT doc_id, base, c, unnest(range(0, least(n, 100))) AS i FROM chunks)),
firsts AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, p FROM windows JOIN firsts USING (s) WHERE first < doc_id),
islands AS (SELECT doc_id, p, sum(CASE WHEN p - before <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS k
  FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM hits)),
runs AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM islands GROUP BY doc_id, k),
pieces AS (
  SELECT doc_id, a, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS start, a AS stop FROM runs
  UNION ALL SELECT doc_id, 1000000000, max(b), 1000000000 FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * start + 1, 2 * (stop - start)), '' ORDER BY a) AS h FROM pieces JOIN d USING (doc_id) GROUP BY doc_id),
counted AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN counted USING (doc_id)""",
    "op5_line_dedup": r"""
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
every AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS no, unnest(lines) AS line FROM cut),
counting AS (SELECT doc_id, no, trim(line, ' ') AS x FROM every WHERE trim(line, ' ') <> ''),
lines AS (SELECT x, min({'d': doc_id, 'n': no}) AS first, string_split(x, ' ') AS w FROM counting GROUP BY x),
long AS (SELECT * FROM lines WHERE len(w) >= 5),
variants AS (SELECT x, first, len(w) AS n, p, array_to_string(list_concat(w[1 : p - 1], w[p + 1 :]), ' ') AS v FROM (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM long)),
near AS (
  SELECT x FROM (SELECT x, first, min(first) OVER (PARTITION BY n, p, v) AS least FROM variants) WHERE least < first
  UNION SELECT variants.x FROM variants JOIN long ON variants.v = long.x WHERE long.first < variants.first
  UNION SELECT long.x FROM variants JOIN long ON variants.v = long.x WHERE variants.first < long.first),
gone AS (SELECT c.doc_id, c.no FROM counting c JOIN lines l USING (x) LEFT JOIN near USING (x) WHERE near.x IS NOT NULL OR l.first <> {'d': c.doc_id, 'n': c.no}),
rest AS (SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.no) AS text FROM every e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.no = e.no WHERE g.no IS NULL GROUP BY e.doc_id),
dropped AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT cut.doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(text, '')) AS kept_sha256
FROM cut LEFT JOIN rest USING (doc_id) LEFT JOIN dropped USING (doc_id)""",
    "op6_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, hash(array_to_string(w[p : p + least(len(w), 3) - 1], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 0) + 2)) AS p FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, y FROM reach JOIN links ON x = other)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN sizes USING (doc_id)""",
    "op8_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM windows),
places AS (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS p FROM d JOIN sizes ON len(w) >= m),
found AS (SELECT doc_id, places.m, p, item_id FROM places JOIN windows ON windows.m = places.m AND windows.s = array_to_string(w[p : p + places.m - 1], ' ')),
hits AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS x FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
