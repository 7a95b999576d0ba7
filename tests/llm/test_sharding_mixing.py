import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkveil.llm import stages
from inkveil.llm.common import WORD
from inkveil.llm.mixing import apply_mix, mix, targets
from inkveil.llm.sharding import jump, shard

SF = "/root/testdata/sf0.001"


def jump_slowly(key, shards):
    """The published algorithm, a key at a time."""
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_equals_the_published_loop():
    keys = np.array([0, 1, -1, 12345, 2**63 - 1, -(2**63), *range(500)], dtype=np.int64)
    for shards in (1, 2, 8, 9, 1000):
        assert jump(keys, shards).tolist() == [jump_slowly(int(k), shards) for k in keys]
    with pytest.raises(ValueError, match="1 or more"):
        jump(keys, 0)


def check_shards(rows, texts):
    assert len(rows) == len(texts)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.law == "key" and 0 <= r.shard < 8
        assert r.shard == jump_slowly(r.doc_id or 0, 8) and r.grown_shard in (r.shard, 8)
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))
    want = sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts)
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in rows) == [(d or 0, s, c) for d, s, c in want]


def test_shards_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_shards(shard(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_shards_of_odd_rows(spark):
    texts = [(0, None), (0, ""), (5, "é" * 1000), (5, "same"), (5, "same"), (5, "same"), (7, "x" * 200_000)]
    docs = spark.createDataFrame([(d, t, "a", 1) for d, t in texts], "doc_id long, text string, shard string, slot int")
    check_shards(shard(docs).collect(), texts)
    assert shard(docs.limit(0)).count() == 0
    null = shard(spark.createDataFrame([(None, "t")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.shard, r.slot) for r in null] == [(None, jump_slowly(0, 8), 0)]


def fill(sizes, weights=(5, 2, 1), cap=3.0):
    """Targets by resharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = float(sum(sizes.values())), {}
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(full.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s: cap * sizes[s] for s in rest if share[s] > cap * sizes[s] + 1e-9}
        if not over:
            return full | share
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 1000}, {"a": 0, "b": 5, None: 7}, {"x": 1}, {"a": 1, "b": 1, "c": 1, "d": 10_000, "é": 3, "z": 2}, {"a": 0, "b": 0}])
def test_targets_equal_resharing(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in targets(rows).collect()}
    want = fill(sizes)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def check_mix(docs, near):
    rows = mix(docs).collect()
    texts = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect()]
    assert sorted(map(str, [(r.doc_id, r.source, r.size) for r in rows])) == sorted(map(str, texts))
    sizes, taken = collections.Counter(), collections.Counter()
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - fill(sizes)[r.source]) < 1e-6
        assert abs(taken[r.source] - r.target) <= near * r.target
    assert sorted(map(str, mix(docs).collect())) == sorted(map(str, rows))


def test_mix_of_all_documents(spark):
    check_mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 0.06)


def test_mix_of_odd_rows(spark):
    rows = [(1, "a", None), (2, "a", ""), (3, None, "x y"), (4, "b", "w " * 30), *[(5, "b", "p q r")] * 40, *[(9 + i, "a", "m n o p") for i in range(60)]]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, source string, text string, target int")
    check_mix(docs, 0.2)
    assert mix(docs.limit(0)).count() == 0


def test_mixed_documents_are_as_many_as_taken(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: r.copies for r in mix(docs).collect() if r.copies}
    got = apply_mix(docs)
    assert got.columns == docs.columns
    assert dict(collections.Counter(r.doc_id for r in got.collect())) == want


def test_mix_stays_in_spark(spark):
    plan = mix(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_draw_equals_pareto_sampling_by_hand(spark):
    """Inclusion by size, whole copies, and the order of odds over inclusion odds, from the hashes that Spark gives."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mix(docs).collect()
    by_source = collections.defaultdict(list)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    name = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))
    u = {d: (((x % (1 << 64)) >> 11) + 0.5) * 2.0**-53 for d, x in docs.select("doc_id", F.xxhash64(F.lit(17), "doc_id", name, size)).collect()}
    for r in rows:
        by_source[r.source].append(r)
    unequal = 0
    for some in by_source.values():
        weight = {r.doc_id: 2.0 ** (math.floor(4 * math.log2(max(1, r.size))) * 0.25 / 4) for r in some}
        low, high = 0.0, 1e9  # the level by halving
        for _ in range(200):
            level = (low + high) / 2
            words = sum(min(3.0, level * weight[r.doc_id]) * r.size for r in some)
            low, high = (level, high) if words < some[0].target else (low, level)
        mean = {r.doc_id: min(3.0, low * weight[r.doc_id]) for r in some}
        part = {d: m - math.floor(m + 1e-9) for d, m in mean.items()}
        unequal += len({round(p, 6) for p in part.values()}) > 1
        assert all(r.copies - math.floor(mean[r.doc_id] + 1e-9) in (0, 1) for r in some)
        left = sum(part[r.doc_id] * r.size for r in some)
        drawn = [r for r in some if part[r.doc_id] > 1e-9]
        order = sorted(drawn, key=lambda r: u[r.doc_id] / (1 - u[r.doc_id]) / (part[r.doc_id] / (1 - part[r.doc_id])))
        for long in (True, False):
            ranked = [r for r in order if (r.size > left * 0.02) == long and r.size]
            hits = [r.copies > math.floor(mean[r.doc_id] + 1e-9) for r in ranked]
            assert hits == sorted(hits, reverse=True)  # a beginning of the order
    assert unequal >= len(by_source) // 2


def test_names_that_clash(spark):
    """Columns named as the operators' own go through the stages that carry documents on."""
    rows = [(1, "a", "one two a@b.co " * 5), (1, "a", "one two a@b.co " * 5), (2, None, None), (None, "b", "three"), (3, "b", "x " * 100_000)]
    names = ["more", "mix_n", "mix_copies", "with_id", "with_hash", "stays", "_id", "_n", "n", "Copies", "size", "node", "selected"]
    docs = spark.createDataFrame([(*r, "en", 1, *range(len(names))) for r in rows], "doc_id long, source string, text string, lang string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    for stage in (stages.select_quality, stages.drop_near_copies, stages.mask_personal_data, stages.mix_sources):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.collect() is not None
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert len(stages.encode_pieces(spark, docs, SF).collect()) == len(rows)


def test_a_row_repeated_many_times(spark):
    docs = spark.range(10_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.lit("x y").alias("text"))
    slots = [r.slot for r in shard(docs).collect()]
    assert sorted(slots) == list(range(10_000))
    assert mix(docs).count() == 10_000
