"""The registered queries opN_<name> and, where DuckDB can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, embeddings, html_text, langid, mixing, packing, quality, rules, simhash, toxicity
from .common import fold, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.filter(fold("doc_id", 5) != 0), "quality")
    return quality.classify(docs, model, ["doc_id"], threshold=0.3).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(fold("doc_id", 3) != 1), "toxic")
    return toxicity.classify(docs, model, ["doc_id"], threshold=0.7).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, budget=3).select("doc_id", "fingerprint", "component_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), (5, 2, 1), 1.5, 2).select("doc_id", "size", "source_size", "target", "taken")


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(fold("doc_id", 4) != 2))
    return langid.predict(docs, model, ["doc_id"]).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    counted = rules.statistics(docs, ["doc_id"])
    found = rules.learn(counted, labels)
    return rules.judge(counted, found).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, counts = ctw.fit(docs.filter(fold("doc_id", 5) != 1))
    return ctw.score(docs, model, counts, ["doc_id"]).select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract_text(pages, ["page_id"]).select("page_id", "text", "n_lines", F.length("text").cast("long").alias("n_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality, op2_toxicity, op3_simhash, op4_mixing, op5_embeddings, op6_language, op7_rules, op8_packing, op9_lm, op10_html)
}

ORACLE_SQL: dict[str, str] = {
    "op4_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), chr(30)) || chr(31) || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s
), o AS (
  SELECT *, row_number() OVER (ORDER BY CAST(source_size AS DOUBLE) / w, source NULLS LAST) AS k FROM w
), l AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - CAST(2.0 AS DOUBLE) * coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM o
), t AS (
  SELECT *, arg_min(level, k) FILTER (WHERE 2.0::DOUBLE * source_size >= level * w) OVER () AS theta FROM l
), g AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, theta * w) AS target FROM t
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS ratio FROM g
), n AS (
  SELECT *, CAST(floor(ratio) AS BIGINT) AS whole, target - CAST(floor(ratio) AS BIGINT) * source_size AS need FROM r
), z AS (
  SELECT source, size, count(*) * size AS words FROM d WHERE size > 0 GROUP BY source, size
), y AS (
  SELECT z.*, n.need, CAST(coalesce(sum(words) OVER (PARTITION BY z.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS larger,
    sum(words * sqrt(size)) OVER (PARTITION BY z.source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS below
  FROM z JOIN n ON z.source IS NOT DISTINCT FROM n.source WHERE n.need > 0
), x AS (
  SELECT source, max(size) AS top, arg_max((need - larger) / below, size) AS scale, arg_max(larger, size) AS certain FROM y WHERE (need - larger) / below * sqrt(size) < 1 GROUP BY source
), m AS (
  SELECT n.source, source_size, target, whole, top, scale, need - coalesce(certain, 0) AS need FROM n LEFT JOIN x ON n.source IS NOT DISTINCT FROM x.source
), j AS (
  SELECT d.doc_id, d.source, d.size, d.u, m.source_size, m.target, m.whole, m.need, coalesce(d.size > m.top, false) AS sure, CASE WHEN d.size > 0 AND d.size <= m.top THEN m.scale * sqrt(d.size) END AS p
  FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source
), q AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM j
), c AS (
  SELECT *, sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source, p > 0 ORDER BY q, size ROWS UNBOUNDED PRECEDING) AS upto FROM q
)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN sure OR (p > 0 AND upto - size / 2.0::DOUBLE <= need) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM c
""",
}
