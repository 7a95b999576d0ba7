"""Comparing proposed redactions with those that were accepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import at_least_about, isclose, stripped


def _same(p: str, f: str) -> Column:
    return (
        (F.col(f"{p}.doc_id") == F.col(f"{f}.doc_id"))
        & (F.col(f"{p}.page_no") == F.col(f"{f}.page_no"))
        & (stripped(F.col(f"{p}.text")) == stripped(F.col(f"{f}.text")))
        & isclose(F.col(f"{p}.y0"), F.col(f"{f}.y0"))
        & isclose(F.col(f"{p}.y1"), F.col(f"{f}.y1"))
    )


def true_positives(proposed: DataFrame, final: DataFrame) -> DataFrame:
    """Proposed annotations (doc_id, page_no, text, y0, y1) that a final one equals: on the
    same page, the same text without punctuation around, the same height."""
    return proposed.alias("p").join(final.alias("f"), _same("p", "f"), "left_semi")


def false_positives(proposed: DataFrame, final: DataFrame) -> DataFrame:
    return proposed.alias("p").join(final.alias("f"), _same("p", "f"), "left_anti")


def compare(proposed: DataFrame, final: DataFrame, match: str = "any") -> DataFrame:
    """(doc_id, n_proposed, n_final, true_positives, false_positives, false_negatives) a document.

    Finals count on pages with a proposal only, and false negatives are finals less true
    positives. match "any": a final may confirm several proposals; "one_to_one": equal ones
    are paired off in order, so that no final counts twice.
    """
    if match not in ("any", "one_to_one"):
        raise ValueError(f"match is any or one_to_one, not {match}")
    if match == "one_to_one":
        key = ["doc_id", "page_no", "plain", "low", "high"]
        nth = lambda df: df.select("doc_id", "page_no", stripped(F.col("text")).alias("plain"), F.round("y0", 6).alias("low"), F.round("y1", 6).alias("high")).groupBy(*key).agg(F.count("*").alias("n"))
        pairs = nth(proposed).join(nth(final).withColumnRenamed("n", "m"), key)
        hits = pairs.groupBy("doc_id").agg(F.sum(F.least("n", "m")).alias("tp"))
    else:
        hits = true_positives(proposed, final).groupBy("doc_id").agg(F.count("*").alias("tp"))
    pages = proposed.select("doc_id", "page_no").distinct()
    finals = final.join(pages, ["doc_id", "page_no"], "left_semi").groupBy("doc_id").agg(F.count("*").alias("nf"))
    counted = proposed.groupBy("doc_id").agg(F.count("*").alias("n_proposed")).join(finals, "doc_id", "left").join(hits, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return counted.select(
        "doc_id", "n_proposed", zero("nf").alias("n_final"), zero("tp").alias("true_positives"),
        (F.col("n_proposed") - zero("tp")).alias("false_positives"), (zero("nf") - zero("tp")).alias("false_negatives"),
    )


def match_ratio(expected: DataFrame, texts: DataFrame, threshold: float, relative: float = 0.1) -> DataFrame:
    """(doc_id, n_expected, n_found, ratio, passes): of expected strings (doc_id, term), those that
    the document's text holds, case aside; passing is at the threshold or just below it."""
    joined = expected.join(texts.select("doc_id", F.lower("text").alias("low")), "doc_id")
    counted = joined.groupBy("doc_id").agg(F.count("*").alias("n_expected"), F.count_if(F.contains("low", F.lower("term"))).alias("n_found"))
    ratio = F.col("n_found") / F.col("n_expected")
    return counted.withColumn("ratio", ratio).withColumn("passes", at_least_about(ratio, F.lit(threshold), relative))


def first_rules(proposals: DataFrame) -> DataFrame:
    """The first rule's row of each term of a document."""
    w = Window.partitionBy("doc_id", "term").orderBy("rule_name", "ordinal")
    return proposals.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")
