"""The queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlframe.llm import (
    chat,
    decontaminate,
    hmm,
    kneser_ney,
    license_scan,
    near_dup,
    pack,
    pii,
    quality,
    token_count,
)

#: The session's setting that holds the key of the surrogates. Without one a key that everyone knows is taken, which hides nothing.
PII_KEY = "spark.crawlframe.pii.key"


def pii_key(spark: SparkSession) -> bytes:
    return spark.conf.get(PII_KEY, "no secret: set spark.crawlframe.pii.key").encode()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file; its folder is installed on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring conversations (2i, 2i + 1) as chosen and rejected: the table has no preferences of its own."""
    turns = _table(spark, sf_dir, "conversations")
    return chat.preference(turns, F.floor(F.col("conv_id") / 2).cast("bigint"), F.col("conv_id") % 2 == 0)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = pii.checked_replace(_table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))
    return replaced.select("doc_id", "text", F.size("__pii").cast("bigint").alias("n_entities"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(_table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), k=2, percent=80)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_token_counts": op4_token_counts,
    "op5_pii": op5_pii,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_hmm_scoring": op7_hmm_scoring,
    "op8_license_scan": op8_license_scan,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op1_quality_rules": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents
), g AS (
  SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3)
), r AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (
    SELECT doc_id, unnest([p, p + 1, p + 2]) AS q
    FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1
  ) GROUP BY doc_id
), l AS (
  SELECT doc_id, count(*) - count(DISTINCT x) AS n
  FROM (SELECT doc_id, unnest(lines) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id
), b AS (
  SELECT doc_id, t, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * n_symbols <= 7 * word_chars AND word_chars BETWEEN 2 * n_words AND 15 * n_words
  AND (n_dup_lines <= 3 OR 100 * n_dup_lines <= 30 * n_lines)
  AND 2 * length(regexp_replace(t, '\P{L}+', '', 'g')) >= word_chars
  AND NOT regexp_matches(t, '[^\x20\x09-\x0D]{201}') AS kept
FROM f
""",
    "op2_chat_formatting": r"""
WITH d AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), p AS (
  SELECT conv_id // 2 AS pair_id,
    coalesce(list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) FILTER (conv_id % 2 = 0), []) AS c,
    coalesce(list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) FILTER (conv_id % 2 = 1), []) AS r
  FROM d GROUP BY 1
), n AS (
  SELECT *, coalesce(list_min(list_filter(range(1, greatest(len(c), len(r)) + 1), lambda i: c[i] IS DISTINCT FROM r[i])) - 1, len(c)) AS n FROM p
), t AS (
  SELECT pair_id, n, c[1 : n] AS p, c[n + 1 :] AS c, r[n + 1 :] AS r FROM n
), x AS (
  SELECT pair_id, n, p, c, r,
    list_transform(p, lambda t: '<|' || t.role || '|>' || chr(10) || replace(t.text, '<|', '< |') || '<|end|>' || chr(10)) AS ps,
    list_transform(c, lambda t: '<|' || t.role || '|>' || chr(10) || replace(t.text, '<|', '< |') || '<|end|>' || chr(10)) AS cs,
    list_transform(r, lambda t: '<|' || t.role || '|>' || chr(10) || replace(t.text, '<|', '< |') || '<|end|>' || chr(10)) AS rs
  FROM t
)
SELECT pair_id, n::BIGINT AS n_prompt_turns, array_to_string(ps, '') AS prompt, array_to_string(cs, '') AS chosen, array_to_string(rs, '') AS rejected,
  array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: c[i].role = 'assistant'), lambda i:
    (length(array_to_string(cs[1 : i - 1], '')) + length(c[i].role) + 5) || '-' || (length(array_to_string(cs[1 : i], '')) - 1)), ',') AS chosen_spans,
  array_to_string(list_transform(list_filter(range(1, len(r) + 1), lambda i: r[i].role = 'assistant'), lambda i:
    (length(array_to_string(rs[1 : i - 1], '')) + length(r[i].role) + 5) || '-' || (length(array_to_string(rs[1 : i], '')) - 1)), ',') AS rejected_spans,
  len(list_filter(c, lambda t: t.role = 'assistant')) > 0 AND len(list_filter(r, lambda t: t.role = 'assistant')) > 0 AS usable
FROM x
""",
    "op9_minhash_near_dedup": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(
    CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), d AS (
  SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM s GROUP BY doc_id
), r AS (
  SELECT min(doc_id) AS doc_id FROM d GROUP BY h
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE a.doc_id IN (SELECT doc_id FROM r) AND b.doc_id IN (SELECT doc_id FROM r)
  GROUP BY 1, 2
), l AS (
  SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
  WHERE 100 * x >= 80 * (na.n + nb.n - x)
  UNION ALL
  SELECT m.lo AS a, d.doc_id AS b FROM d JOIN (SELECT h, min(doc_id) AS lo FROM d GROUP BY h) m ON m.h = d.h AND m.lo < d.doc_id
), e AS (
  SELECT a, b FROM l UNION SELECT b, a FROM l
), c AS (
  SELECT doc_id AS id, doc_id AS reach FROM documents
  UNION
  SELECT c.id, e.b FROM c JOIN e ON e.a = c.reach
), m AS (
  SELECT id, min(reach) AS component_id FROM c GROUP BY id
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, component_id = doc_id AS kept
FROM documents JOIN m ON m.id = doc_id LEFT JOIN n USING (doc_id)
""",
    "op10_benchmark_decontamination": rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), i AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k,
    unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda p: array_to_string(w[p : p + least(len(w), 13) - 1], ' '))) AS g
  FROM b WHERE len(w) > 0
), o AS (
  SELECT doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') AS g
  FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)
), f AS (
  SELECT DISTINCT doc_id, k, p, item_id FROM o JOIN i USING (k, g)
), h AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM f) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM f) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
""",
}
