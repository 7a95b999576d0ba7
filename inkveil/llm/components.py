"""Connected components of a graph held as edges, without gathering any component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _afresh(df: DataFrame) -> DataFrame:
    """df settled, without the size that its plan was estimated at: a join's is the product of its
    sides', and settled tables carry it on, so that round by round the driver would hold numbers
    of twice as many digits and more."""
    spark, held = df.sparkSession, settle(df)
    return DataFrame(spark._jsparkSession.createDataFrame(held._jdf.javaRDD(), held._jdf.schema()), spark)


def _jumped(parents: DataFrame) -> DataFrame:
    """Point every node straight at its root by doubling the jumps; a root has no row."""
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("further"))
        parents = _afresh(parents.join(above, "parent", "left").select("node", F.coalesce("further", "parent").alias("parent"), F.col("further").isNotNull().alias("moved")))
        if parents.filter("moved").isEmpty():
            return parents.select("node", "parent")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b), where root is the smallest node of its component.

    Each round lets every node point at its smallest neighbour if that is smaller,
    follows the pointers to the end, and goes on with the edges between the roots
    that are left; a star takes one round, and a chain of n nodes about log n. Rows
    with a null end and loops are ignored; no edges give no rows.
    """
    left = _afresh(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not left.isEmpty():
        found = _jumped(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")))
        root = found.withColumnRenamed("parent", "root")
        if labels is None:
            labels = root.unionByName(left.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct().join(root, "node", "left_anti"))
        else:
            step = root.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        labels = _afresh(labels)
        ends = left
        for end in ("a", "b"):
            ends = ends.join(root.select(F.col("node").alias(end), F.col("root").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        left = _afresh(ends.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return labels if labels is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))
