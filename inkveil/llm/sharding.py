"""Sharding by jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, settle

#: The multiplier of the published algorithm's 64-bit linear congruential generator.
STEP = 2862933555777941757


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key, by jump consistent hashing: no ring table, and going
    from n to n + 1 shards moves a key only into the new shard n."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    key = keys.astype(np.int64).view(np.uint64).copy()
    held = np.zeros(len(key), dtype=np.int64)
    todo = np.arange(len(key))
    while len(todo):
        key[todo] = key[todo] * np.uint64(STEP) + np.uint64(1)
        lot = (key[todo] >> np.uint64(33)).astype(np.float64) + 1.0
        to = ((held[todo] + 1) * (float(1 << 31) / lot)).astype(np.int64)
        on = to < shards
        todo = todo[on]
        held[todo] = to[on]
    return held.astype(np.int32)


def jump_shard(key, shards: int):
    """Column: the shard of a bigint key; a null key counts as 0."""

    @F.pandas_udf("int")
    def of(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(np.int64), shards))

    return of(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def shard(docs: DataFrame, shards: int = 8, grown: int | None = None, buckets: int = 1024) -> DataFrame:
    """Place documents (doc_id, text) into shards 0 to shards - 1 and number them there.

    Returns doc_id, size (UTF-8 bytes + 1), text_crc32, law ("key"), shard, slot
    (gapless from 0 in each shard), grown_shard (the shard with `grown` shards, one
    more by default). A null text has no bytes (size 1, crc 0); a null doc_id is
    placed as key 0; repeated rows keep one slot each; other columns are ignored; no
    rows give no rows.

    Slots come without gathering a shard: rows that are equal are counted first, each
    shard is cut into `buckets` parts by hash, the parts' sizes (shards x buckets rows,
    whatever the input) are summed up in order, and rows are numbered within a part.
    """
    grown = grown or shards + 1
    base = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    key = ["doc_id", "size", "text_crc32"]
    counted = settle(
        base.groupBy(*key)
        .agg(F.count("*").alias("n"))
        .withColumn("shard", jump_shard(F.col("doc_id"), shards))
        .withColumn("grown_shard", jump_shard(F.col("doc_id"), grown))
        .withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    )
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = (
        counted.groupBy("shard", "bucket")
        .agg(F.sum("n").alias("n"))
        .select("shard", "bucket", before(Window.partitionBy("shard").orderBy("bucket")).alias("start"))
    )
    within = counted.withColumn("ahead", before(Window.partitionBy("shard", "bucket").orderBy(*key)))
    placed = numbered(within.join(F.broadcast(starts), ["shard", "bucket"]), "n", "nth")  # shards x buckets rows
    return placed.select(*key, F.lit("key").alias("law"), "shard", (F.col("start") + F.col("ahead") + F.col("nth")).alias("slot"), "grown_shard")
