"""What is settled leaves no shuffle behind."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from inkveil.llm.common import settle


def test_shuffles_go_when_a_table_is_settled(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f.name for d in manager.localDirsString() for f in Path(d).rglob("shuffle_*.data")}
    before = held()
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    settled = settle(df)
    end = time.monotonic() + 10
    while held() - before and time.monotonic() < end:  # they go in the background
        time.sleep(0.1)
    assert not held() - before
    assert settled.agg(F.sum("n")).first()[0] == 1000 and df.count() == 7  # and df can still be read
