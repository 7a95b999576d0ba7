"""Queries of the llm operators, with the SQL that states the same where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline

from . import decontamination, lm_scoring, mixing, ngram_join, oracles, pieces, pii, quality_classifier, quality_rules, sharding, target_resampling, toxicity, vector_search, whitening
from .common import table


def op1_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"), shards=8)


def op2_pii(spark, sf_dir):
    return pii.pii(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark, sf_dir):
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), n=3, percent=90).drop("text_hash")


def op4_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark, sf_dir):
    return lm_scoring.lm_scores(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_classifier(spark, sf_dir):
    return quality_classifier.quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


def op8_vector_search(spark, sf_dir):
    return vector_search.nearest(table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_pieces(spark, sf_dir):
    return pieces.encode(table(spark, sf_dir, "documents"))


def op11_target_resampling(spark, sf_dir):
    drawn = target_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_decontamination(spark, sf_dir):
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op13_whitening(spark, sf_dir):
    """A deviation past the range of a long is null here; the operator has it as a decimal."""
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES = (
    op1_sharding,
    op2_pii,
    op3_ngram_join,
    op4_mixing,
    op5_lm_scoring,
    op6_quality_rules,
    op7_quality_classifier,
    op8_vector_search,
    op9_toxicity,
    op10_pieces,
    op11_target_resampling,
    op12_decontamination,
    op13_whitening,
)


# What SQL can say of the operators' results, held against it over the whole tables.


def shard_of_keys(spark, sf_dir):
    """op1 without the slots' order: a shard's slots are gapless if their greatest is the number of its rows less one."""
    rows = op1_sharding(spark, sf_dir)
    sums = rows.groupBy("shard").agg((F.max("slot") + 1).alias("top"), F.countDistinct("slot").alias("slots"))
    sums = sums.select("shard", F.when(F.col("top") == F.col("slots"), F.col("top")).alias("shard_rows"))
    return rows.join(F.broadcast(sums), "shard").select("doc_id", "size", "law", "shard", "grown_shard", "shard_rows")


def pii_counts(spark, sf_dir):
    return op2_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def mixing_targets(spark, sf_dir):
    return op4_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def lm_base(spark, sf_dir):
    return op5_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def quality_base(spark, sf_dir):
    return op6_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def vector_search_exact(spark, sf_dir):
    """The search with all candidates reranked."""
    rows = vector_search.nearest(table(spark, sf_dir, "embeddings"), share=1.0)
    return rows.select("query_id", "rank", "vec_id", F.round("score", 9).alias("score"))


def toxicity_rows(spark, sf_dir):
    fine = F.col("score").between(0, 1) & (F.col("predicted") == (F.col("score") >= 0.5).cast("int"))
    return op9_toxicity(spark, sf_dir).select("doc_id", "held_out", fine.alias("in_range"))


def whitening_base(spark, sf_dir):
    return op13_whitening(spark, sf_dir).select("vec_id", "component", "n", "deviation")


QUERIES += (shard_of_keys, pii_counts, mixing_targets, lm_base, quality_base, vector_search_exact, toxicity_rows, whitening_base)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES} | {"pipeline": corpus_pipeline.run}


#: Shingles of all documents, their links by counting what they share, and what links reach.
NGRAM_JOIN = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, coalesce(k, 0) AS n_links
FROM documents d LEFT JOIN sizes USING (doc_id)
LEFT JOIN (SELECT x AS doc_id, min(y) AS low FROM reach GROUP BY x) USING (doc_id)
LEFT JOIN (SELECT x AS doc_id, count(*) AS k FROM links GROUP BY x) USING (doc_id)"""


def oracle_sql() -> dict:
    return {
        "op3_ngram_join": NGRAM_JOIN,
        "shard_of_keys": oracles.SHARDS,
        "pii_counts": oracles.PII_COUNTS,
        "mixing_targets": oracles.TARGETS,
        "lm_base": oracles.LM_BASE,
        "quality_base": oracles.QUALITY_BASE,
        "vector_search_exact": oracles.NEAREST,
        "toxicity_rows": oracles.HELD_OUT,
        "op11_target_resampling": oracles.RESAMPLED,
        "op12_decontamination": oracles.CONTAMINATED,
        "whitening_base": oracles.DEVIATIONS,
    }
