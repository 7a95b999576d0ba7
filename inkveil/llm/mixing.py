"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, numbered, settle, unlike

BEFORE = (Window.unboundedPreceding, -1)
#: So many sources at most are sent to all tasks.
FEW = 50_000


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, total: float | None = None) -> DataFrame:
    """Add `target` to a table of sources (source, source_size): the share of the total by
    weight, at most cap x source_size, what is over reshared by weight until none is above.

    Weights go round in the sources' code-point order, null last. One fill level
    answers the resharing: target = min(level x weight, cap x size). Sources in the
    order in which they fill up give a level each, and the first that it does not
    overfill is right. The table has a row a source, so one task holds it.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("full_at", "place")
    held = sizes.withColumn("place", F.row_number().over(by_name) - 1)
    held = (
        held.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % n + 1).cast("int")))
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("full_at", F.col("most") / F.col("weight"))
        .withColumn("total", F.lit(float(total)) if total is not None else F.sum("source_size").over(Window.partitionBy()).cast("double"))
        .withColumn("full", F.coalesce(F.sum("most").over(by_fill.rowsBetween(*BEFORE)), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("full")) / F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("rank", F.row_number().over(by_fill))
    )
    first = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("rank", "level"))).over(Window.partitionBy())
    level = F.coalesce(first["level"], F.max("full_at").over(Window.partitionBy()))
    return held.withColumn("target", F.least(level * F.col("weight"), F.col("most"))).select("source", "source_size", "target")


def copies(classes: DataFrame, cap: float) -> DataFrame:
    """Add `mean`, the expected copies of a document, to a table of each source's classes
    (mixed, weight, words, target): in proportion to the class's weight, at most cap, and so
    that a source's words come to its target. One fill level a source answers this, as in
    `targets`; a source has some hundred classes at most."""
    of = Window.partitionBy("mixed")
    by_fill = of.orderBy(F.desc("weight"))
    held = (
        classes.withColumn("full_at", F.lit(float(cap)) / F.col("weight"))
        .withColumn("full", F.coalesce(F.sum(F.col("words") * F.lit(float(cap))).over(by_fill.rowsBetween(*BEFORE)), F.lit(0.0)))
        .withColumn("open", F.sum(F.col("words") * F.col("weight")).over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.when(F.col("open") > 0, (F.col("target") - F.col("full")) / F.col("open")))
    )
    first = F.max_by("level", F.when(F.col("level") <= F.col("full_at"), F.col("weight"))).over(of)
    level = F.coalesce(first, F.max("full_at").over(of))
    return held.withColumn("mean", F.least(level * F.col("weight"), F.lit(float(cap)))).drop("full_at", "full", "open", "level")


def _choose(rows: DataFrame, buckets: int) -> DataFrame:
    """Take rows of each source in Pareto order while their words come nearer to `want`.

    The order is cut into `buckets` ranges; their words are summed up per source, so
    that a row needs only the rows of its own range. Rows that are equal stay counted
    (`n`) up to the end.
    """
    words = F.col("size") * F.col("n")
    rows = rows.repartition("mixed", "bucket")  # else a join by source leaves each source in one task
    sums = rows.groupBy("mixed", "bucket").agg(F.sum(words).alias("words"))
    sums = sums.select("mixed", "bucket", F.coalesce(F.sum("words").over(Window.partitionBy("mixed").orderBy("bucket").rowsBetween(*BEFORE)), F.lit(0)).alias("start"))
    w = Window.partitionBy("mixed", "bucket").orderBy("order", "doc_id", "size").rowsBetween(*BEFORE)
    at = F.col("start") + F.col("ahead")
    return (
        rows.withColumn("ahead", F.coalesce(F.sum(words).over(w), F.lit(0)))
        .join(sums, ["mixed", "bucket"])
        # of n equal rows, as many as start by `want` less half a row
        .withColumn("hits", F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(F.col("n"), F.floor((F.col("want") - at) / F.col("size") + 0.5)))).otherwise(0).cast("long"))
        .drop("ahead", "start")
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 17, buckets: int = 4096, large: float = 0.02, tilt: float = 0.25) -> DataFrame:
    """Say how many words the mix takes from each document (doc_id, source, text).

    A document's expected copies go with its size to the power `tilt` (by classes of
    sizes, four to a doubling), at most `cap`, so that its source's words come to the
    target (`copies`). Whole copies are certain. For its fraction left, p, a document is
    drawn: the documents of a source are ranked by their random odds U / (1 - U) divided by
    their own inclusion odds p / (1 - p) and taken in this order until the words wanted
    are reached (a fixed size in words, to half a document). Documents with over `large` of
    the words wanted are drawn first and on their own, so that the others can make good
    what a long one missed.

    Returns doc_id, size, source_size, target, taken, source, copies: a row a document,
    copies 0 for one that is left out. U is a hash of the document, so that reruns agree.
    A null text has size 0 and takes nothing; a null source is a source of its own,
    last; equal rows are drawn as so many documents; no rows give no rows; other columns
    are ignored.
    """
    base = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    mixed = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))
    of_size = F.floor(4 * F.log2(F.greatest(F.lit(1).cast("long"), F.col("size")))).cast("int")
    counted = settle(base.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")).withColumn("mixed", mixed).withColumn("class", of_size))
    classes = settle(counted.groupBy("source", "mixed", "class").agg(F.sum(F.col("size") * F.col("n")).alias("words")))
    wanted = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap).withColumn("mixed", mixed).drop("source")
    plan = settle(
        copies(classes.drop("source").join(wanted, "mixed").withColumn("weight", F.pow(F.lit(2.0), F.col("class") * (tilt / 4))), cap)
        .withColumn("mean", F.when(F.col("source_size") > 0, F.col("mean")).otherwise(0.0))
        .withColumn("whole", F.floor(F.col("mean") + 1e-12))
        .withColumn("part", F.greatest(F.lit(0.0), F.col("mean") - F.col("whole")))
        .withColumn("left", F.sum(F.col("part") * F.col("words")).over(Window.partitionBy("mixed")))
        .drop("words", "weight", "mean")
    )
    # a table of some rows a source goes to every task if it is small; else a large source's rows are split by the join
    few = plan.count() <= FEW
    near = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "mixed", "size"), 11) + 0.5) * F.lit(2.0**-53)
    odds = (u / (1 - u)) / (F.col("part") / (1 - F.col("part")))
    ranked = (
        counted.join(near(plan), ["mixed", "class"])
        .withColumn("odds", F.when(F.col("part") > 0, odds))
        .withColumn("order", F.col("odds") / (1 + F.col("odds")))  # the same order, within 0 and 1
        .withColumn("bucket", F.least(F.lit(buckets - 1), F.floor(F.col("order") * buckets)).cast("int"))
        .withColumn("long", F.col("size") > F.col("left") * large)
    )
    drawn = ranked.filter("part > 0")
    long = drawn.filter("long").groupBy("mixed").agg(F.sum(F.col("size") * F.col("n") * F.col("part")).alias("want"))
    first = settle(_choose(drawn.filter("long").join(near(long), "mixed"), buckets).drop("want"))
    had = first.groupBy("mixed").agg(F.sum(F.col("size") * F.col("hits")).alias("had"))
    then = _choose(drawn.filter("NOT long").join(near(had), "mixed", "left").withColumn("want", F.col("left") - F.coalesce("had", F.lit(0))).drop("had"), buckets).drop("want")
    rest = ranked.filter("NOT part > 0").withColumn("hits", F.lit(0).cast("long"))
    out = first.unionByName(then).unionByName(rest)
    # equal rows stand apart again: the first `hits` of them have the copy more
    return numbered(out, "n", "i").withColumn("copies", (F.col("whole") + F.when(F.col("i") < F.col("hits"), 1).otherwise(0)).cast("long")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies"
    )


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """docs as often as the mix takes each, all columns kept; those with no copy go.

    Rows that are equal in doc_id, source and size take their copies together, as so
    many rows; which of them is told by the text's hash, then at random.
    """
    keys = ["doc_id", "source", "size"]
    k_id, k_source, k_size, copies_, n, at, share, copy = unlike(docs.columns, "id", "of", "size", "copies", "n", "at", "share", "copy")
    mixed = mix(docs, **options).groupBy(*keys).agg(F.sum("copies").alias(copies_), F.count("*").alias(n)).filter(F.col(copies_) > 0)
    mixed = mixed.select(F.col("doc_id").alias(k_id), F.col("source").alias(k_source), F.col("size").alias(k_size), copies_, n)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    joined = docs.join(mixed, F.col("doc_id").eqNullSafe(F.col(k_id)) & F.col("source").eqNullSafe(F.col(k_source)) & (size == F.col(k_size)))
    # a group of one row, as nearly all are, needs no order
    w = Window.partitionBy(k_id, k_source, k_size).orderBy(F.xxhash64("text"))
    several = joined.filter(F.col(n) > 1).withColumn(at, F.row_number().over(w) - 1)
    each = joined.filter(F.col(n) == 1).withColumn(at, F.lit(0)).unionByName(several)
    more = F.floor(F.col(copies_) / F.col(n)) + F.when(F.col(at) < F.col(copies_) % F.col(n), 1).otherwise(0)
    taken = each.withColumn(share, more.cast("int")).filter(F.col(share) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(share)))).select(*[F.col(f"`{c}`") for c in docs.columns])
