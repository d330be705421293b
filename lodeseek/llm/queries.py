"""The queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import context_tree, decontaminate, language, mixture, rule_ledger, secrets, shingle_join, toxicity, url_templates, warc

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


OP2_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (h)
"""


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(_read(spark, sf_dir, "pages"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(_read(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = rule_ledger.ledger(_read(spark, sf_dir, "documents"))
    kept = rule_ledger.apply_policy(led, rule_ledger.POLICIES["2024-1"])
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~rule_ledger.passes(rule_ledger.BASE)).alias("base_failed"), "kept", "failed")


OP7_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), g AS (
  SELECT r, i, w[i:i + 4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM g) WHERE k > 1
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         len(regexp_extract_all(t, '!')) AS n_exclaims, len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(regexp_extract_all(t, '[0-9]')) AS n_digits
  FROM d LEFT JOIN covered USING (r)
), f AS (
  SELECT *, CAST({" + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, (_, rule) in enumerate(rule_ledger.RULES))} AS BIGINT) AS failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & {rule_ledger.BASE.mask}) <> 0 AS base_failed, (failed & {rule_ledger.POLICIES["2024-1"].mask}) = 0 AS kept, failed
FROM f
"""


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: hits(doc_id, p, item_id): the words of documents inside occurrences of windows.
HITS_CTE = f"""
d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
b AS (SELECT item_id, {_TERMS} AS w FROM benchmark),
wins AS (
  SELECT item_id, w[s:s + 9] AS g, least(len(w), 10) AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT k FROM wins),
places AS (SELECT doc_id, pos, k, w[pos:pos + k - 1] AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS pos FROM d, sizes WHERE len(w) >= k)),
hits AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + p.k)) AS p, item_id FROM places p JOIN wins v ON p.g = v.g AND p.k = v.k)"""
OP8_SQL = f"""
WITH {HITS_CTE},
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits GROUP BY doc_id),
dw AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS p FROM d),
df AS (SELECT term, count(*) AS df FROM dw GROUP BY term),
it AS (SELECT DISTINCT i, item_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS i, item_id, w FROM b WHERE len(w) > 0)),
ranked AS (SELECT i, item_id, term, coalesce(df, 0) AS df, row_number() OVER (PARTITION BY i ORDER BY coalesce(df, 0), term) - 1 AS rank FROM it LEFT JOIN df USING (term)),
rare AS (SELECT *, max(rank) OVER (PARTITION BY i) + 1 AS lists, min(df) OVER (PARTITION BY i) AS least FROM ranked WHERE rank < {decontaminate.NEAR_TERMS}),
seen AS (SELECT doc_id, i, item_id, rank, lists, p FROM rare JOIN dw USING (term) WHERE least > 0),
near AS (
  SELECT a.doc_id, a.item_id FROM seen a JOIN seen b ON a.doc_id = b.doc_id AND a.i = b.i AND a.rank = 0 AND abs(b.p - a.p) <= {decontaminate.NEAR_SPAN}
  GROUP BY a.doc_id, a.i, a.item_id, a.p, a.lists HAVING count(DISTINCT b.rank) = a.lists
),
nn AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM near GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN nn USING (doc_id)
"""


def op9_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.taken(_read(spark, sf_dir, "documents")).drop("source")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.jaccard_components(_read(spark, sf_dir, "documents"))


#: reach(doc_id, r): documents that links lead to; sets(doc_id, s): distinct shingles.
REACH_CTE = rf"""
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) WHEN len(w) > 0 THEN [w] ELSE [] END AS s FROM words
),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM sets UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)"""
OP10_SQL = f"""
WITH RECURSIVE {REACH_CTE}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id
FROM sets JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_warc": op2_warc,
    "op3_url_filter": op3_url_filter,
    "op4_lm_score": op4_lm_score,
    "op5_language_id": op5_language_id,
    "op6_toxicity": op6_toxicity,
    "op7_quality_rules": op7_quality_rules,
    "op8_decontamination": op8_decontamination,
    "op9_source_mixture": op9_source_mixture,
    "op10_ngram_jaccard": op10_ngram_jaccard,
}
ORACLES: dict[str, str] = {"op2_warc": OP2_SQL, "op7_quality_rules": OP7_SQL, "op8_decontamination": OP8_SQL, "op10_ngram_jaccard": OP10_SQL}
