"""Quality classifier: importance resampling with hashed n-gram models and Gumbel top-k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORDS_AND_MARKS, giving_back, mix64, settle, token_hashes

BUCKETS = 20_000


def features(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all texts' tokens (words, and runs of marks) and of their pairs of
    neighbouring tokens; and of each feature the text that it is of."""
    tokens, ends = token_hashes(texts, WORDS_AND_MARKS, lower=False)
    of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    pairs = mix64(tokens[:-1] * np.uint64(0x9E3779B97F4A7C15) + tokens[1:])[of[:-1] == of[1:]]
    return (np.concatenate([tokens, pairs]) % np.uint64(buckets)).astype(np.int64), np.concatenate([of, of[:-1][of[:-1] == of[1:]]])


def _count(targets: set, buckets: int):
    """Bucket counts of all texts and of the target ones, summed up within a task."""

    def run(batches):
        raw, target, texts = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = part.column("doc_id").to_pylist()
                got, of = features(part.column("text"), buckets)
                texts += len(ids)
                raw += np.bincount(got, minlength=buckets)
                good = np.array([i in targets for i in ids], bool)
                target += np.bincount(got[good[of]], minlength=buckets)
        if texts:
            used = np.flatnonzero(raw)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "raw", "target"])

    return run


def _gumbel(doc_id, text_hash, seed: int):
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text_hash), 11) + 0.5) * F.lit(2.0**-53)
    return -F.log(-F.log(u))


def top_k(rows: DataFrame, k: int, bins: int = 1024, rounds: int = 4) -> DataFrame:
    """Mark the k rows of the greatest `key`, exactly; ties go by doc_id, null last.

    The cut is closed in on by histograms of `bins` bins, so that only the rows of one
    fine bin are put in order. rows is to be settled: it is read a few times.
    """
    total, low, high = rows.agg(F.count("*"), F.min("key"), F.max("key")).first()
    if k >= total or total == 0:
        return rows.withColumn("selected", F.lit(total > 0))
    if k <= 0:
        return rows.withColumn("selected", F.lit(False))
    high = float(np.nextafter(high, np.inf))
    above = 0
    for _ in range(rounds):
        width = (high - low) / bins
        if not low < low + width < high:
            break
        edges = [low + j * width for j in range(bins)] + [high]
        place = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("key") - low) / width))).cast("int")
        counts = dict(rows.filter((F.col("key") >= low) & (F.col("key") < high)).groupBy(place.alias("bin")).agg(F.count("*")).collect())
        at = bins - 1
        while above + counts.get(at, 0) < k:
            above += counts.get(at, 0)
            at -= 1
        if (edges[at], edges[at + 1]) == (low, high):
            break
        # the bins' sides are what the comparison says, not the division
        low, high = edges[max(0, at - 1)], edges[min(bins, at + 2)]
        above = rows.filter(F.col("key") >= high).count()
        if counts.get(at, 0) < 64:
            break
    # what is left lies within one bin: it is cut by key and then by doc_id, equal rows counted as one
    inner = rows.filter((F.col("key") >= low) & (F.col("key") < high))
    alike = inner.groupBy("key", "doc_id").agg(F.count("*").alias("alike"))
    w = Window.orderBy(F.desc("key"), F.col("doc_id").asc_nulls_last())
    cut = alike.withColumn("ahead", F.sum("alike").over(w.rowsBetween(Window.unboundedPreceding, -1))).filter(F.coalesce("ahead", F.lit(0)) < k - above).orderBy(F.asc("key"), F.col("doc_id").desc_nulls_first()).limit(1).collect()
    last = cut[0]
    past = F.col("doc_id").isNotNull() if last.doc_id is None else F.col("doc_id") < last.doc_id
    sure = (F.col("key") > last.key) | ((F.col("key") == last.key) & F.coalesce(past, F.lit(False)))
    at = (F.col("key") == last.key) & F.col("doc_id").eqNullSafe(F.lit(last.doc_id))
    room = k - above - (last.ahead or 0)
    if room >= last.alike:
        return rows.withColumn("selected", sure | at)
    # of equal rows at the very cut as many are taken as there is room for: the first ones of a few parts
    tied = rows.filter(at).withColumn("part", F.spark_partition_id())
    sizes = dict(tied.groupBy("part").count().collect())
    starts, ahead = {}, 0
    for part in sorted(sizes):
        starts[part], ahead = ahead, ahead + sizes[part]
    first = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv])
    nth = F.row_number().over(Window.partitionBy("part").orderBy("key"))
    taken = tied.withColumn("selected", first[F.col("part")] + nth <= room).drop("part")
    return rows.filter(~at).withColumn("selected", sure).unionByName(taken)


def quality_classifier(docs: DataFrame, labels: DataFrame, most: int = 20_000, buckets: int = BUCKETS, shrink: float = 500.0, least: float = 0.05, seed: int = 29) -> DataFrame:
    """Select documents (doc_id, text) that look drawn from the good ones of labels (doc_id, quality).

    Two bags of hashed tokens and token pairs are estimated: of the target texts (those
    of quality 1 in a sample of at most `most` labelled rows, by hash of the doc_id) and
    of all texts, the first smoothed towards the second by `shrink` counts a bucket. A
    document's weight is its probability under the first over that under the second;
    log_weight is the sum of its features' log ratios. Documents are sampled without
    replacement with chances by weight: the k greatest of log_weight + Gumbel noise, where
    k is the number of documents whose weight is above `least`.

    Returns doc_id, log_weight, key, selected: a row for each row of docs. A null or empty
    text has log_weight 0. Without any label of quality 1 all log_weights are 0 and all
    documents are selected; null labels are not used; a doc_id that is labelled both ways
    is good; equal rows have equal weights and noise, and the cut takes them in the order
    of doc_id, as many as there is room for; no rows give no rows; other columns are
    ignored. The noise is a hash of the document, so that reruns agree.
    """
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    rows = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = rows.orderBy(F.xxhash64("doc_id")).limit(most).collect()
    targets = {r.doc_id for r in sample if r.quality == 1}
    counted = base.select("doc_id", "text").mapInArrow(giving_back(_count(targets, buckets)), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in counted.collect():  # a row a bucket at most
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    ratio = np.log((target + shrink) / (raw * (target.sum() / max(1.0, raw.sum())) + shrink))

    def score(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got, of = features(part.column("text"), buckets)
                weights = np.bincount(of, weights=ratio[got], minlength=part.num_rows).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(weights)], names=["doc_id", "text_hash", "log_weight"])

    scored = base.mapInArrow(giving_back(score), "doc_id long, text_hash long, log_weight double")
    scored = settle(scored.withColumn("key", F.col("log_weight") + _gumbel(F.col("doc_id"), F.col("text_hash"), seed)))
    k = scored.filter(F.col("log_weight") > F.log(F.lit(least))).count() if targets else scored.count()
    return top_k(scored, k).select("doc_id", "log_weight", "key", "selected", "text_hash")
