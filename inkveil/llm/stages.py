"""The stages of the corpus pipeline, each a function (spark, docs, sf_dir) to a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, ngram_join, pieces, pii, quality_classifier
from .common import settle, table, unlike


def _named(columns) -> list:
    return [F.col(f"`{c}`") for c in columns]


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier selects; the others go. Rows equal in doc_id and
    text stay together if one of them is selected."""
    chosen = quality_classifier.quality_classifier(docs, table(spark, sf_dir, "labels"))
    with_id, with_hash = unlike(docs.columns, "with_id", "with_hash")
    gone = chosen.groupBy(F.col("doc_id").alias(with_id), F.col("text_hash").alias(with_hash)).agg(F.max("selected").alias("any")).filter("NOT any").drop("any")
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(with_id)) & (F.xxhash64("text") == F.col(with_hash)), "left_anti")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest doc_id. Near
    copies share 0.8 of their five-word shingles. Of rows equal in doc_id and text one
    stays, whatever their other columns. Documents without words stay, and so do those
    whose group has no doc_id at all."""
    groups = settle(ngram_join.ngram_join(docs, n=5, percent=80).filter("n_shingles > 0 AND component_id IS NOT NULL"))
    first = groups.filter("doc_id = component_id").groupBy("component_id").agg(F.min("text_hash").alias("first_hash"))
    ranked = groups.join(first, "component_id").withColumn("stays", F.expr("doc_id <=> component_id AND text_hash = first_hash"))
    seen = ranked.groupBy("doc_id", "text_hash").agg(F.max("stays").alias("stays"), F.count("*").alias("rows"))
    with_id, with_hash, stays = unlike(docs.columns, "with_id", "with_hash", "stays")
    told = seen.filter("NOT stays OR rows > 1").select(F.col("doc_id").alias(with_id), F.col("text_hash").alias(with_hash), F.col("stays").alias(stays))
    wide = docs.join(told, F.col("doc_id").eqNullSafe(F.col(with_id)) & (F.xxhash64("text") == F.col(with_hash)), "left")
    once = wide.filter(F.col(stays)).select(*_named(docs.columns)).dropDuplicates(["doc_id", "text"])
    return wide.filter(F.col(stays).isNull()).select(*_named(docs.columns)).unionByName(once)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked by kind."""
    return pii.mask_personal_data(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the sources' weights takes them, 0 to 3 times."""
    return mixing.apply_mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, and whether decoding gives its text again."""
    return pieces.encode(docs)
