"""Applying redactions to text, and removing proposals without applying them."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import locator, matching


def mask_patterns(text: Column, patterns: dict[str, str], mark: str = "█") -> Column:
    """Text with each match of the patterns, in their order, as a row of marks in a fixed length."""
    return reduce(lambda c, p: F.regexp_replace(c, p, mark * 5), patterns.values(), text)


def apply_redactions(docs: DataFrame, boxes: DataFrame, lines: DataFrame, mark: str = "█") -> DataFrame:
    """Lines of words (doc_id, line_no, words) with every word that a box (doc_id, line_no,
    first, last) covers replaced by marks: (doc_id, line_no, text, n_masked)."""
    per_line = boxes.groupBy("doc_id", "line_no").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    covered = lambda i: F.exists("spans", lambda s: (i >= s["first"]) & (i <= s["last"]))
    lines = lines.withColumn("n_words", F.size("words"))  # for whom counts do, words aren't moved
    wide = lines.join(per_line, ["doc_id", "line_no"], "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<first:int,last:int>>")))
    masked = F.transform("words", lambda w, i: F.when(covered(i), F.repeat(F.lit(mark), F.length(w))).otherwise(w))
    some = F.size("spans") > 0  # most lines have none: their words aren't gone through
    n = F.when(some, F.size(F.filter(F.sequence(F.lit(0), F.col("n_words") - 1), covered))).otherwise(0)
    return wide.select("doc_id", "line_no", F.array_join(F.when(some, masked).otherwise(F.col("words")), " ").alias("text"), n.alias("n_masked"))


def _status(n: DataFrame) -> DataFrame:
    n_ = F.coalesce("n_redactions", F.lit(0)).cast("long")
    return n.select("doc_id", n_.alias("n_redactions"), F.when(n_ > 0, "SUCCESS").otherwise("FAIL").alias("status"))


def redaction_status(docs: DataFrame, masked: DataFrame) -> DataFrame:
    """(doc_id, n_redactions, status): documents without any redaction fail, as there is nothing to redact."""
    n = masked.groupBy("doc_id").agg(F.sum("n_masked").alias("n_redactions"))
    return _status(docs.select("doc_id").join(n, "doc_id", "left"))


def boxes_status(docs: DataFrame, boxes: DataFrame) -> DataFrame:
    """The same of boxes (doc_id, line_no, first, last) that are applied to the lines of docs (doc_id, text).
    Each line's number of words is taken in the task, a row a text; words and lines are not moved."""
    sizes = docs.select("doc_id", *matching.texts_or_lines(F.col("text"))).mapInArrow(partial(locator.line_sizes, "doc_id"), f"doc_id {dict(docs.dtypes)['doc_id']}, sizes array<int>")
    spans = boxes.groupBy("doc_id").agg(F.collect_set(F.struct(*[F.col(c).cast("long").alias(c) for c in ("line_no", "first", "last")])).alias("spans"))
    held = sizes.join(spans, "doc_id")
    n = held.mapInArrow(partial(locator.covered_words, "doc_id"), f"doc_id {dict(docs.dtypes)['doc_id']}, n long").groupBy("doc_id").agg(F.sum("n").alias("n_redactions"))
    return _status(docs.select("doc_id").join(n, "doc_id", "left"))


def terms_status(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The same of terms that are sought in all documents, counted where they are found: nothing is moved."""
    return _status(matching.masked_words(docs, terms).withColumnRenamed("n_masked", "n_redactions"))


def sanitise_markup(html: Column) -> Column:
    """Markup without comments, scripts, styles, attributes and metadata elements; the text stays."""
    rules = ((r"(?s)<!--.*?-->", ""), (r"(?is)<(?:script|style|head)[^>]*>.*?</(?:script|style|head)>", ""), (r"<([A-Za-z][A-Za-z0-9]*)\s[^>]*>", "<$1>"))
    return reduce(lambda c, r: F.regexp_replace(c, *r), rules, html)


def sanitise(annotated: DataFrame) -> DataFrame:
    """Documents without their annotations and metadata, nothing redacted."""
    return annotated.drop("annotations", "metadata")
