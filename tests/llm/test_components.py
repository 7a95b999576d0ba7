"""Components over many rounds, and what the plans of their rounds are estimated at."""

from pyspark.sql import functions as F

from inkveil.llm.components import components


def test_estimates_do_not_multiply_round_by_round(spark):
    # chains whose nodes are in no order take several rounds, each with several jumps
    n = 3000
    ids = F.xxhash64((F.col("id") + 1).cast("string"))
    edges = spark.range(n).filter("id % 100 < 99").select(F.xxhash64(F.col("id").cast("string")).alias("a"), ids.alias("b"))
    found = components(edges)
    assert (found.count(), found.select("root").distinct().count()) == (n, n // 100)
    told = found.join(edges.select(F.col("a").alias("node"), "b"), "node").join(found.select(F.col("node").alias("b"), F.col("root").alias("other")), "b")
    assert told.filter("root <> other").isEmpty()
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 256
