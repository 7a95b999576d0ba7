"""Approximate nearest neighbours by a permutation index."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, partitions, settle

FOUND = "name string, found binary"
LONGS = pa.list_(pa.int64())
#: Vectors are dealt into so many parts at least, where a part has 2048 then; not the session's figure, as what is found depends on it.
LEAST_PARTS = 32


def _pack(most: int, queries_by: int):
    """Valid vectors as (vector, its smallest ids, its query ids), equal vectors of a batch together."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                groups: dict[bytes, list[int]] = {}
                part = batch.slice(at, 4096)
                for vec_id, values in zip(part.column("vec_id").to_pylist(), part.column("embedding").to_pylist(), strict=True):
                    if vec_id is None or not values or None in values:
                        continue
                    v = np.array(values, np.float64) + 0.0  # one zero
                    if np.isfinite(v).all() and v.any():
                        groups.setdefault(v.tobytes(), []).append(vec_id)
                names = list(groups)
                ids = [np.array(groups[k], np.int64) for k in names]
                asked = [x[x % queries_by == 0] for x in ids]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([np.sort(x)[:most] for x in ids], LONGS), pa.array(asked, LONGS)], names=["vector", "ids", "asked"])

    return run


def prefixes(vectors: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Each vector's nearest pivots, nearest first, ties to the smaller number."""
    d = (pivots**2).sum(axis=1)[None, :] - 2 * vectors @ pivots.T
    part = np.argpartition(d, min(length, d.shape[1]) - 1, axis=1)[:, :length] if length < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(d), 1))
    order = np.lexsort((part, np.take_along_axis(d, part, axis=1)), axis=1)
    return np.take_along_axis(part, order, axis=1)


class Index:
    """Vectors of one dimension posted under their nearest pivots with the pivots' ranks."""

    def __init__(self, vectors: np.ndarray, pivots: np.ndarray, length: int):
        self.vectors, self.pivots, self.length = vectors, pivots, min(length, len(pivots))
        near = prefixes(vectors, pivots, self.length)
        flat, rank = near.reshape(-1), np.tile(np.arange(self.length, dtype=np.int32), len(vectors))
        owner = np.repeat(np.arange(len(vectors), dtype=np.int64), self.length)
        order = np.argsort(flat, kind="stable")
        cuts = np.searchsorted(flat[order], np.arange(len(pivots) + 1))
        self.lists = [(owner[order[a:b]], rank[order[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def candidates(self, query: np.ndarray, most: int) -> np.ndarray:
        """The vectors of the least footrule distance to the query's permutation, a pivot
        outside a prefix counting as just after its end; all that tie with the last."""
        near = prefixes(query[None, :], self.pivots, self.length)[0]
        # sum of ranks' differences = all apart, less what each shared pivot makes good
        gain = np.zeros(len(self.vectors), np.int32)
        for r, p in enumerate(near):
            owner, rank = self.lists[p]
            gain[owner] += 2 * self.length - r - rank - np.abs(r - rank)
        if most >= len(gain):
            return np.arange(len(gain))
        least = np.partition(gain, len(gain) - most)[len(gain) - most]
        return np.flatnonzero(gain >= least)

    def search(self, query: np.ndarray, k: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(distance, place) of the k nearest candidates, reranked in double precision; all ties of the last."""
        some = self.candidates(query, most)
        d = np.sqrt(((self.vectors[some] - query) ** 2).sum(axis=1))
        if len(some) > k:
            keep = d <= np.partition(d, k - 1)[k - 1]
            some, d = some[keep], d[keep]
        return d, some


def _search(pivots: dict, k: int, length: int, share: float):
    """Rows sorted by (part, turn, asks) to each query's nearest in the part: a part's vectors
    come first and make the index, then the queries of the turn come by, some at a time."""

    def run(batches):
        of, vectors, ids, indexes = None, [], [], None

        def built():
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_size.setdefault(len(v), []).append(i)
            return {size: (np.array(own), Index(np.stack([np.frombuffer(vectors[i], np.float64) for i in own]), pivots[size], length)) for size, own in by_size.items() if size in pivots}

        for batch in batches:
            out = []
            for part, turn, asks, name, vector, some in zip(*(batch.column(c).to_pylist() for c in ("part", "turn", "asks", "name", "vector", "ids")), strict=True):
                if (part, turn) != of:
                    of, vectors, ids, indexes = (part, turn), [], [], None
                if not asks:
                    vectors.append(vector)
                    ids.append(some)
                    continue
                indexes = built() if indexes is None else indexes
                if len(vector) in indexes:
                    own, index = indexes[len(vector)]
                    d, near = index.search(np.frombuffer(vector, np.float64), k + 1, max(k + 1, math.ceil(share * len(own))))
                    # a vector's ids are those of equal rows: all at this distance, the smallest first
                    out.append((name, _best([(x, i) for x, s in zip(d.tolist(), near.tolist(), strict=True) for i in ids[own[s]]], k)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([b for _, b in out], pa.binary())], names=["name", "found"])

    return run


def _best(pairs: list[tuple[float, int]], k: int) -> bytes:
    """The k + 1 nearest, ties to the smaller id: one of them may be the query's own row."""
    return np.array(sorted(pairs)[: k + 1], dtype=[("d", np.float64), ("i", np.int64)]).tobytes()


def _merge(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        flat = np.frombuffer(b"".join(pdf["found"]), dtype=[("d", np.float64), ("i", np.int64)])
        return pd.DataFrame({"name": [pdf["name"].iloc[0]], "found": [_best(flat.tolist(), k)]})

    return run


def nearest(vectors: DataFrame, k: int = 10, queries_by: int = 100, pivots: int = 256, sample: int = 4096, length: int = 48, share: float = 0.15, part: int = 16_384, turn: int = 65_536) -> DataFrame:
    """The k nearest other rows of each query, by Euclidean distance (vec_id, embedding).

    Queries are the rows whose vec_id is divisible by `queries_by`, against all rows.
    Returns query_id, rank (from 1), vec_id, score (the distance in double precision):
    nearest first, ties to the smaller vec_id, all rows if there are fewer than k. Vectors
    that are null, empty, zero or hold null or non-finite components take no part, nor do
    rows without a vec_id; only vectors of one dimension are compared; no rows give no
    rows; other columns are ignored. A vec_id that is repeated stands for as many rows.

    `pivots` vectors of a sample of about `sample` rows, chosen far from each other, are
    the pivots. Equal vectors are one entry with their k + 1 smallest ids, which are all
    that a query can need of them. Entries are dealt into parts of about `part` vectors, and
    queries into turns of about `turn`; each (part, turn) is a group of bounded size: its
    vectors are posted under their `length` nearest pivots, and each query ranks those that
    share pivots by footrule distance and reranks the best `share` of them exactly. With
    `share` 1 all are reranked. The results of the parts are merged by query.
    """
    spark = vectors.sparkSession
    packed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_pack(k + 1, queries_by), "vector binary, ids array<long>, asked array<long>")
    # a vector is known by 128 bits of its own; its queries stay rows of their own, however many
    packed = packed.withColumn("name", F.md5("vector"))
    together = (F.first("vector").alias("vector"), F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"), F.max("asks").alias("asks"))
    # equal vectors meet in two steps, so that a frequent one is not one task's
    salted = packed.withColumn("asks", F.size("asked") > 0).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(16)))
    entries = settle(salted.groupBy("name", "salt").agg(*together).groupBy("name").agg(*together).withColumn("place", F.xxhash64("vector")))
    count, asking = entries.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    # a sample by hash, so that no more than about `sample` rows leave the executors
    level = int(min(1.0, sample / max(1, count)) * (1 << 62))
    by_size: dict[int, list] = {}
    for r in entries.filter(F.shiftrightunsigned("place", 2) <= level).select("place", "vector").collect():
        by_size.setdefault(len(r.vector), []).append((r.place, np.frombuffer(bytes(r.vector), np.float64)))
    for r in entries.groupBy(F.length("vector").alias("size")).agg(F.min_by("vector", "place").alias("vector")).collect():  # a dimension that the sample missed
        by_size.setdefault(r.size, [(0, np.frombuffer(bytes(r.vector), np.float64))])
    chosen = {size: _apart(np.stack([v for _, v in sorted(some, key=lambda x: x[0])]), pivots) for size, some in by_size.items()}
    parts, turns = max(1, -(-count // part), min(LEAST_PARTS, count // 2048)), max(1, -(-asking // turn))
    own = entries.select(F.pmod(F.shiftright("place", 20), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(turns - 1).cast("long"))).alias("turn"), F.lit(0).alias("asks"), "name", "vector", "ids")
    named = entries.filter("asks")
    asked = named.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.pmod(F.shiftright("place", 20), F.lit(turns)).alias("turn"), F.lit(1).alias("asks"), "name", "vector", F.lit(None).cast("array<long>").alias("ids"))
    met = own.unionByName(asked).repartition(max(parts * turns, partitions(spark, 8)), "part", "turn").sortWithinPartitions("part", "turn", "asks")
    best = met.mapInArrow(_search(chosen, k, length, share), FOUND).groupBy("name").applyInPandas(_merge(k), FOUND)

    def expand(batches):
        for batch in batches:
            out = [[], [], [], []]
            for asked, found in zip(batch.column("asked").to_pylist(), batch.column("found").to_pylist(), strict=True):
                pairs = np.frombuffer(found, dtype=[("d", np.float64), ("i", np.int64)]).tolist()
                for q in asked:
                    own = next((n for n, (_, i) in enumerate(pairs) if i == q), None)
                    rest = [p for n, p in enumerate(pairs) if n != own][:k]
                    for rank, (d, i) in enumerate(rest, 1):
                        for column, value in zip(out, (q, rank, i, d), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.float64())], names=["query_id", "rank", "vec_id", "score"])

    queries = packed.filter(F.size("asked") > 0).select("name", "asked")  # 4096 rows of the input have given each at most
    return queries.join(best, "name").select("asked", "found").mapInArrow(expand, "query_id long, rank int, vec_id long, score double")


def _apart(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots far from each other: each next one is the sample's farthest from those taken."""
    start = int(mix64(np.array([len(sample)], np.uint64))[0] % np.uint64(len(sample)))
    taken = [start]
    far = ((sample - sample[start]) ** 2).sum(axis=1)
    while len(taken) < min(count, len(sample)):
        taken.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[taken[-1]]) ** 2).sum(axis=1))
    return sample[taken]


def brute_nearest(ids: np.ndarray, vectors: np.ndarray, queries: list[int], k: int) -> dict[int, list[tuple[float, int]]]:
    """The same by measuring all rows; for tests and recall."""
    out = {}
    for q in queries:
        d = np.sqrt(((vectors - vectors[np.flatnonzero(ids == q)[0]]) ** 2).sum(axis=1))
        order = np.lexsort((ids, d))
        out[q] = [(float(d[j]), int(ids[j])) for j in order if ids[j] != q][:k]
    return out
