"""Text as pages, lines and words with places.

A line is what a line feed ends, if it has a word; lines are numbered without gaps and
ten make a page. A line's box is 10 high, 20 below the one before; a word begins where
the words before it and a space each end. All of it is worked out within a row, so that
no stage here moves data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BLANK, DROPPED, NARROW, normalised_words

LINES_A_PAGE, LINE_HEIGHT = 10, 10


def page_of(line_no: Column) -> Column:
    return F.floor(line_no / LINES_A_PAGE).cast("int")


def line_top(line_no: Column) -> Column:
    """y0 of a line."""
    return (20 * (line_no % LINES_A_PAGE)).cast("double")


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, page_no, line_in_page, words, y0, y1): one row for each line with words."""
    words = F.filter(F.transform(F.split(text, "\n"), normalised_words), lambda w: F.size(w) > 0)
    return (
        # an outer explode, as the other one is preceded by a test of its input, which would be worked out twice
        docs.select(key, F.posexplode_outer(words).alias("line_no", "words"))
        .filter("line_no IS NOT NULL")
        .withColumn("page_no", page_of(F.col("line_no")))
        .withColumn("line_in_page", F.col("line_no") % LINES_A_PAGE)
        .withColumn("y0", line_top(F.col("line_no")))
        .withColumn("y1", F.col("y0") + LINE_HEIGHT)
    )


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, gpos, line_no, pos, word): one row for each word, gpos counting through the document."""
    words = F.filter(F.transform(F.split(text, "\n"), normalised_words), lambda w: F.size(w) > 0)
    placed = F.flatten(F.transform(words, lambda w, line: F.transform(w, lambda x, at: F.struct(line.alias("line_no"), at.alias("pos"), x.alias("word")))))
    return docs.select(key, F.posexplode_outer(placed).alias("gpos", "t")).filter("gpos IS NOT NULL").select(key, "gpos", "t.*")


def word_start(words: Column, at: Column) -> Column:
    """x0 of the word at a place of its line."""
    return F.when(at > 0, F.length(F.array_join(F.slice(words, 1, at), " ")) + 1).otherwise(0).cast("double")


def word_starts(words: Column) -> Column:
    """x0 of all words of a line, an array, in one pass over them however long the line is."""

    def run(lines_: pd.Series) -> pd.Series:
        ends = (np.cumsum(np.fromiter((len(w) + 1 for w in ws), np.float64, len(ws))) for ws in lines_)
        return pd.Series([np.concatenate([[0.0], e[:-1]]) if len(e) else e for e in ends], dtype=object)

    return F.pandas_udf(run, "array<double>")(words)


def word_end(words: Column, at: Column) -> Column:
    """x1 of the word at a place of its line."""
    return F.length(F.array_join(F.slice(words, 1, at + 1), " ")).cast("double")


def page_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, page_no, raw_text): pages of ten raw lines, cleaned, in the document's order."""
    raw = F.split(text, "\n")
    pages = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(raw) / LINES_A_PAGE).cast("int") - 1))
    joined = F.transform(pages, lambda p: F.array_join(F.slice(raw, p * LINES_A_PAGE + 1, LINES_A_PAGE), "\n"))
    cleaned = F.transform(joined, lambda x: F.btrim(F.translate(x, NARROW + DROPPED, " "), F.lit(BLANK)))
    return docs.select(key, F.posexplode_outer(cleaned).alias("page_no", "raw_text")).filter("page_no IS NOT NULL")


def with_next_page(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each page with the one after it, null at the end."""
    return pages.withColumn("next_text", F.lead("raw_text").over(Window.partitionBy(key).orderBy("page_no")))


def segment_lines(words: DataFrame, key: str = "page_id") -> DataFrame:
    """Raw words (key, seq, block_no, line_no, word, x0, y0, x1, y1) in reading order to lines.

    A line begins where the block or line number changes; words are normalised, empty
    ones go, lines without words go and the rest are numbered without gaps. A line has
    its words with x0 and x1 each, and the least y0 and greatest y1.
    """
    w = Window.partitionBy(key).orderBy("seq")
    changed = F.coalesce((F.lag("block_no").over(w) != F.col("block_no")) | (F.lag("line_no").over(w) != F.col("line_no")), F.lit(False))
    run = words.withColumn("run", F.sum(changed.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = run.withColumn("plain", F.array_join(normalised_words(F.col("word")), " ")).filter("plain <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("seq", "plain", "x0", "x1")))
    grouped = kept.groupBy(key, "run").agg(ordered.alias("o"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    return grouped.select(
        key,
        (F.row_number().over(Window.partitionBy(key).orderBy("run")) - 1).alias("line_number"),
        F.transform("o", lambda x: x["plain"]).alias("words"),
        F.transform("o", lambda x: x["x0"]).alias("x0"),
        F.transform("o", lambda x: x["x1"]).alias("x1"),
        "y0",
        "y1",
    )


def reading_order(words: DataFrame, key: str = "page_id", gap: float = 20.0, lean: float = 0.25) -> DataFrame:
    """Words (key, x0, y0, x1, y1, ...) in the order in which they are read: with column_no, line_no
    in the column, pos in the line and seq on the page, all from 0.

    Three sweeps, each over one page at a time. From left to right a column begins where all
    words so far end more than `gap` before; within it, from the top down, a line begins where
    all words so far, each without `lean` of its height at its top and its foot, end above;
    within the line words go by x0. Columns are read one after the other. A word across the
    gap joins the columns on both its sides. No order of the rows is taken as given; words at
    one place go by their foot and their end.
    """
    across = Window.partitionBy(key).orderBy("x0", "y0", "x1", "y1")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    step = lambda new: F.coalesce(new, F.lit(False)).cast("int")
    columns = words.withColumn("new__", step(F.col("x0") > F.max("x1").over(before(across)) + gap)).withColumn("column_no", F.sum("new__").over(so_far(across)).cast("int"))
    inset = (F.col("y1") - F.col("y0")) * lean
    down = Window.partitionBy(key, "column_no").orderBy("top__", "x0", "y1", "x1")
    cut = columns.withColumn("top__", F.col("y0") + inset).withColumn("foot__", F.col("y1") - inset)
    lines_ = cut.withColumn("new__", step(F.col("top__") >= F.max("foot__").over(before(down)))).withColumn("line_no", F.sum("new__").over(so_far(down)).cast("int"))
    along = Window.partitionBy(key, "column_no", "line_no").orderBy("x0", "y0", "x1", "y1")
    placed = lines_.withColumn("pos", (F.row_number().over(along) - 1).cast("int"))
    return placed.withColumn("seq", (F.row_number().over(Window.partitionBy(key).orderBy("column_no", "line_no", "pos")) - 1).cast("int")).drop("new__", "top__", "foot__")
