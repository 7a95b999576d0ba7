"""Importance resampling towards a target distribution: packed bucket streams, counted by sorting."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, parts_of, settle
from .words import Words, by_bytes, crc_space, crc_words, words

#: A block's streams of buckets: its documents, where each one's buckets end, and the buckets as uint16.
BLOCK = "doc_ids array<long>, n_words array<long>, ends array<long>, stream binary"
#: A block closes at so many features.
FEATURES = 1 << 16


def bucket_stream(found: Words, orders: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all features of texts in a row, as uint16, and where each text's end.

    Features are runs of 1 to `orders` consecutive words of one text, joined by one space; a
    bucket is the unsigned crc32 of the feature's bytes modulo `buckets`.
    """
    counts = found.counts()
    of = np.repeat(np.arange(len(counts)), counts)
    state = crc_words(found)
    streams, owners = [(state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)], [of]
    for order in range(2, orders + 1):
        whole = np.flatnonzero(of[: len(of) - order + 1] == of[order - 1 :])  # runs that stay in one text
        # `state` is of the runs that are one word shorter, by their first word
        grown = np.zeros(len(of), np.uint32)
        grown[whole] = crc_words(found, crc_space(state[whole]), whole + order - 1)
        state = grown
        streams.append((state[whole] ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets))
        owners.append(of[whole])
    stream, owner = np.concatenate(streams).astype(np.uint16), np.concatenate(owners)
    if orders > 1:
        stream = stream[np.argsort(owner, kind="stable")]
    return stream, np.cumsum(np.bincount(owner, minlength=len(counts)))


def _pack(orders: int, buckets: int):
    """Texts to blocks of bucket streams; a block holds whole documents."""

    def run(batches):
        for batch in batches:
            for a, b in by_bytes(batch.column("text")):
                part = batch.slice(a, b - a)
                found = words(part.column("text"))
                stream, ends = bucket_stream(found, orders, buckets)
                ids, counts, at = part.column("doc_id").to_pylist(), found.counts(), 0
                while at < len(ids):
                    low = int(ends[at - 1]) if at else 0
                    to = max(at + 1, int(np.searchsorted(ends, low + FEATURES, side="right")))
                    row = [ids[at:to], counts[at:to], ends[at:to] - low]
                    arrays = [pa.array([x], pa.list_(pa.int64())) for x in row]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array([stream[low : int(ends[to - 1])].tobytes()], pa.binary())], names=["doc_ids", "n_words", "ends", "stream"])
                    at = to

    return run


def run_lengths(values: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(value, count) of values, each `times` often: sorted, and equal ones counted as a run."""
    order = np.argsort(values, kind="stable") if times is not None else None
    values = np.sort(values, kind="stable") if order is None else values[order]
    if not len(values):
        return values, np.zeros(0, np.int64)
    begins = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    counts = np.diff(np.append(begins, len(values))) if order is None else np.add.reduceat(times[order], begins)
    return values[begins], counts.astype(np.int64)


def _count(batches):
    """Each block's stream sorted and run-length encoded; a task's runs are merged the same way."""
    values, counts = np.zeros(0, np.uint16), np.zeros(0, np.int64)
    for batch in batches:
        for stream in batch.column("stream"):
            more = run_lengths(np.frombuffer(stream.as_buffer(), np.uint16))
            values, counts = run_lengths(np.concatenate([values, more[0]]), np.concatenate([counts, more[1]]))
    yield pa.RecordBatch.from_arrays([pa.array(values, pa.int32()), pa.array(counts, pa.int64())], names=["bucket", "n"])


def bucket_counts(blocks: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket is in the blocks: `buckets` rows at most reach the driver."""
    out = np.zeros(buckets, np.int64)
    for r in blocks.select("stream").mapInArrow(giving_back(_count), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: 1000 times the log ratio of the two smoothed models, rounded down."""
    buckets, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * float(s_all + buckets) / ((s + 1) * float(t_all + buckets)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def _gather(gain: np.ndarray):
    """A document's weight: the gains of its part of a stream, summed by np.add.reduceat."""

    def run(batches):
        for batch in batches:
            for ids, counts, ends, stream in zip(*(batch.column(c) for c in ("doc_ids", "n_words", "ends", "stream")), strict=True):
                ends = ends.values.to_numpy()
                n_features = np.diff(ends, prepend=0)
                weight, some = np.zeros(len(ends), np.int64), np.flatnonzero(n_features)
                if len(some):  # an empty part would take its neighbour's first gain
                    weight[some] = np.add.reduceat(gain[np.frombuffer(stream.as_buffer(), np.uint16)], (ends - n_features)[some])
                yield pa.RecordBatch.from_arrays([ids.values, counts.values, pa.array(n_features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def noise(doc_id, seed: int):
    """Gumbel noise times 1000 from a hash of the seed and the doc_id (null: none)."""
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))


def ranked(rows: DataFrame, percent: int) -> DataFrame:
    """rows with `rank`: floor(percent * N / 100) of the N `eligible` rows, 1, 2, 3... by falling
    score, ties to the smaller doc_id (null last); the others null.

    rows is settled. They are cut into ranges of the score, sorted within, and a row's number
    is its place in its range after the sizes of the ranges before; no range is all rows.
    """
    good = rows.filter("eligible").withColumn("nth", F.monotonically_increasing_id())
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.asc("nth")]
    in_order = settle(good.repartitionByRange(parts_of(rows, times=1), *order).sortWithinPartitions(*order).drop("nth").withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("place", 33)
    sizes = dict(in_order.groupBy(part.alias("part")).count().collect())  # a row a range
    ahead, total = [], 0
    for p in sorted(sizes):
        ahead.append((p, total))
        total += sizes[p]
    starts = rows.sparkSession.createDataFrame(ahead, "part long, ahead long")
    k = percent * total // 100
    numbers = in_order.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.col("ahead") + F.col("place").bitwiseAND((1 << 33) - 1) + 1)
    taken = numbers.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank"))).select(*rows.columns, "rank")
    return taken.unionByName(rows.filter("NOT eligible").withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, orders: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """Draw `percent` of the documents (doc_id, text) so that they look drawn like target (text).

    Returns doc_id, n_words, n_features, weight, score, rank, a row for each row of docs.
    Features are runs of 1 to `orders` words, hashed to `buckets` (65,536 at most). A bucket's
    gain is the log ratio of its share in the target to that in docs, one added to each bucket's
    count, in thousandths, rounded down; weight is the sum over the document's features, score
    adds Gumbel noise from a hash of the doc_id. Of the documents with `least_words` or more
    words the highest scores are drawn, without replacement; rank counts them from 1, ties to
    the smaller doc_id; those not drawn have null.

    A null or empty text has no words: weight 0, never drawn unless `least_words` is 0. A
    null doc_id is hashed as the text '' and comes last among ties; repeated rows are drawn
    by themselves. An empty target gives gains by docs alone, an empty docs no rows. Other
    columns are ignored.

    Texts are read once: a block of documents becomes a stream of uint16 buckets with offsets,
    settled in the shared folder. Streams are sorted and run-length encoded for the counts;
    afterwards each stream gathers its gains.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are uint16")
    pack = giving_back(_pack(orders, buckets))
    streams = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, BLOCK))
    raw = bucket_counts(streams, buckets)
    wanted = bucket_counts(target.select(F.lit(None).cast("long").alias("doc_id"), "text").mapInArrow(pack, BLOCK), buckets)
    weighed = streams.mapInArrow(giving_back(_gather(gains(raw, wanted))), "doc_id long, n_words long, n_features long, weight long")
    score = F.col("weight") + F.floor(noise(F.col("doc_id"), seed)).cast("long")
    scored = settle(weighed.withColumn("score", score).withColumn("eligible", F.col("n_words") >= least_words))
    return ranked(scored, percent).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
