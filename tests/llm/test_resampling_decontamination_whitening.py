"""Target resampling, decontamination and whitening against plain loops."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from inkveil.llm import decontamination, registry, target_resampling, whitening, words

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


ODD_TEXTS = [None, "", " \n\t", "A", "ÄB-äb É9\x7f_x", "İ ſ Ⅷ 文字列 漢", "a" * 300 + " " + "b" * 47 + " " + "c" * 48 + " " + "d" * 49, "x1,y2;Z3", "end"]


def test_words_and_their_crc32_equal_the_pattern():
    found = words.words(pa.array(ODD_TEXTS))
    spelled = [found.data[a:b].tobytes().decode() for a, b in zip(found.starts, found.ends, strict=True)]
    assert spelled == [w for t in ODD_TEXTS for w in tokens(t)]
    assert found.counts().tolist() == [len(tokens(t)) for t in ODD_TEXTS]
    assert (words.crc_words(found) ^ 0xFFFFFFFF).tolist() == [zlib.crc32(w.encode()) for w in spelled]
    sliced = words.words(pa.array(ODD_TEXTS).slice(3, 4))
    assert sliced.counts().tolist() == [len(tokens(t)) for t in ODD_TEXTS[3:7]]
    assert [b - a for a, b in words.by_bytes(pa.array(["aaaa", None, "b", "cccccccc", ""]), 5)] == [3, 1, 1]


def test_streams_of_longer_runs_equal_the_pattern():
    found = words.words(pa.array(ODD_TEXTS))
    stream, ends = target_resampling.bucket_stream(found, 3, 65_536)
    at = 0
    for text, end in zip(ODD_TEXTS, ends.tolist(), strict=True):
        ws = tokens(text)
        want = [zlib.crc32(" ".join(ws[i : i + n]).encode()) % 65_536 for n in (1, 2, 3) for i in range(len(ws) - n + 1)]
        assert Counter(stream[at:end].tolist()) == Counter(want)
        at = end
    assert at == len(stream) and stream.dtype == np.uint16


def brute_resample(docs, target, orders, buckets, least, percent, seed):
    def streams(text):
        ws = tokens(text)
        return len(ws), [zlib.crc32(" ".join(ws[i : i + n]).encode()) % buckets for n in range(1, orders + 1) for i in range(len(ws) - n + 1)]

    own = [streams(t) for _, t in docs]
    s, t = Counter(b for _, x in own for b in x), Counter(b for x in target for b in streams(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for (d, _), (n, x) in zip(docs, own, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, x))
        out.append([d, n, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    good = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    for rank, r in enumerate(good[: percent * len(good) // 100], 1):
        r[5] = rank
    return Counter(map(tuple, out))


@pytest.mark.parametrize(("orders", "buckets", "least", "percent"), [(1, 10_000, 20, 10), (2, 97, 3, 50), (3, 65_536, 0, 100)])
def test_resample_equals_plain_loops(spark, orders, buckets, least, percent):
    rng = random.Random(orders)
    some = ["alpha", "beta", "Gamma", "δelta", "5", "zeta", "eta", "theta"]
    docs = [(i, " ".join(rng.choices(some, k=rng.randrange(60)))) for i in range(120)]
    docs += [(i, docs[7][1]) for i in range(200, 260)] + [(3, "alpha beta")] * 4 + [(None, "beta " * 30), (None, None), (999, ""), (1000, "q" * 200_000 + " r")]
    target = ["alpha alpha beta", None, "", "theta 5 " * 10]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, N_WORDS string").repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    rows = target_resampling.resample(df, aim, orders, buckets, least, percent).collect()
    assert Counter(map(tuple, rows)) == brute_resample(docs, target, orders, buckets, least, percent, 2024)


def test_resample_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 10), (2, None)], "doc_id long, text string")
    assert target_resampling.resample(none, some).collect() == []
    assert {r.doc_id: r.n_features for r in target_resampling.resample(some, none).collect()} == {1: 30, 2: 0}
    with pytest.raises(ValueError):
        target_resampling.resample(some, some, buckets=70_000)


def test_run_lengths():
    values, counts = target_resampling.run_lengths(np.array([5, 1, 5, 5, 2], np.uint16))
    assert (values.tolist(), counts.tolist()) == ([1, 2, 5], [1, 1, 3])
    values, counts = target_resampling.run_lengths(np.array([2, 1, 2], np.uint16), np.array([4, 1, 6]))
    assert (values.tolist(), counts.tolist()) == ([1, 2], [1, 10])


def brute_decontaminate(docs, items, window):
    held = [("" if i is None else str(i), tokens(t)) for i, t in items]
    out = []
    for d, t in docs:
        ws, hit, names = tokens(t), set(), set()
        for name, own in held:
            size = min(window, len(own))
            runs = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
            for at in range(len(ws) - size + 1):
                if size and tuple(ws[at : at + size]) in runs:
                    hit |= set(range(at, at + size))
                    names.add(name)
        spans = [x for k in sorted(hit) for x in ([k] if k - 1 not in hit else []) + ([k + 1] if k + 1 not in hit else [])]
        out.append((d, len(ws), len(hit), len(names), tuple(sorted(names)), tuple(spans), bool(hit)))
    return Counter(out)


def decontaminated(rows):
    return Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r["items"]), tuple(r.spans), r.contaminated) for r in rows.collect())


@pytest.mark.parametrize("block_bytes", [1 << 23, 300])
@pytest.mark.parametrize("window", [1, 2, 4, 10])
def test_decontaminate_equals_plain_loops(spark, window, block_bytes):
    rng = random.Random(window)
    some = ["a", "b", "c", "é", "1"]
    text = lambda most: " ".join(rng.choices(some, k=rng.randrange(most)))
    items = [(i, text(14)) for i in range(12)] + [(3, "b B b"), (None, "1 1 c"), (50, None), (51, ""), (52, "..."), (53, "c"), (2, "b-b_B!")]
    docs = [(i, text(90)) for i in range(60)] + [(7, "c " * 700), (None, "a b"), (8, None), (9, ""), (9, ""), (10, items[4][1].upper().replace(" ", ",\n")), (11, "c"), (12, "1-1-C")]
    df = spark.createDataFrame([(*d, [1]) for d in docs], "doc_id long, text string, spans array<int>").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminated(decontamination.decontaminate(df, bench, window, block_bytes)) == brute_decontaminate(docs, items, window)


def test_long_items_are_cut_without_losing_windows(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(decontamination, "PIECE", 16)
    item = [f"w{rng.randrange(40)}" for _ in range(333)]
    docs = [(k, "lead " * (k % 3) + " ".join(item[k : k + 12]) + " tail") for k in range(0, 322)]
    pieces = next(iter(decontamination._cut(10)([pa.RecordBatch.from_pydict({"item_id": ["5"], "text": [" ".join(item)]})])))
    assert pieces.num_rows == 21
    table = decontamination.patterns(list(zip(pieces.column("item_id").to_pylist(), pieces.column("text").to_pylist(), strict=True)), 10)
    counts, spans, items = decontamination.scan(pa.array([t for _, t in docs]), table)
    assert all(s == [k % 3, k % 3 + 12] for (k, _), s in zip(docs, spans, strict=True)) and all(x == ["5"] for x in items)
    assert counts.tolist() == [13 + k % 3 for k, _ in docs]


def test_shift_table_skips_and_colliding_slots_are_compared():
    """With one slot for all pairs nothing is skipped, and only comparison tells."""
    own, hashes = decontamination.hashed(pa.array(["a b c d e f"]))
    table = decontamination.Patterns(3, own, hashes, np.arange(4), np.array(["x"] * 4, object))
    assert table.shift.max() == 2 and (table.shift == 2).mean() > 0.9
    found, own_hashes = decontamination.hashed(pa.array(["z c d e z a b", "b c", "b c d"]))
    place, row = table.search(found, own_hashes)
    assert sorted(zip(place.tolist(), table.starts[row].tolist(), strict=True)) == [(1, 2), (9, 1)]
    table.shift[:] = 0
    place, _ = table.search(found, own_hashes)
    assert sorted(place.tolist()) == [1, 9]


def test_decontaminate_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(none, items).collect() == []
    assert decontaminated(decontamination.decontaminate(docs, items)) == Counter([(1, 2, 0, 0, (), (), False), (None, 0, 0, 0, (), (), False)])


def check_whitening(vectors, rows, components=4, scale=256):
    """Against exact sums by fractions and numpy's own covariance."""
    good = [(i, [math.floor(scale * c) for c in v]) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    assert len(rows) == sum(min(components, len(x)) for _, x in good)
    for size in {len(x) for _, x in good}:
        fit = sorted({tuple(x) for _, x in good if len(x) == size})
        n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
        v = np.cov(np.array(fit, np.float64).T, bias=True).reshape(size, size) if n > 1 else np.zeros((size, size))
        e, u = np.linalg.eigh(v)
        e, u, total = e[::-1][:components], u[:, ::-1][:, :components], e.sum()
        want = Counter()
        for i, x in good:
            if len(x) == size:
                deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
                y = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)])
                for k in range(min(components, size)):
                    flat = e[k] <= 1e-9 * max(1.0, total)
                    want[i, k + 1, n, deviation, 0.0 if flat else abs(round(float(y @ u[:, k]) / math.sqrt(e[k]), 6)), 0.0 if flat else round(float(e[k] / total), 6)] += 1
        got = Counter((r.vec_id, r.component, r.n, int(r.deviation), abs(round(r.whitened, 6)) if r.explained > 0 else 0.0, round(r.explained, 6)) for r in rows if r.n == n and r["size"] == size)
        assert got == want


def whitened(df, vectors, components=4):
    sizes = {i: len(v) for i, v in vectors if v}
    rows = whitening.whiten(df, components).collect()
    assert all(r.identity_error <= 1e-9 for r in rows)

    class Row:
        def __init__(self, r):
            self.r = r

        def __getattr__(self, name):
            return getattr(self.r, name)

        def __getitem__(self, name):
            return sizes[self.r.vec_id] if name == "size" else self.r[name]

    return [Row(r) for r in rows]


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(6, 6))
    vectors = [(i, (rng.normal(size=6) @ mix).tolist()) for i in range(80)]
    vectors += [(100 + i, vectors[5][1]) for i in range(40)] + [(5, vectors[5][1])]
    vectors += [(200, None), (201, []), (202, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (203, [math.nan] * 6), (204, [math.inf] * 6), (205, [0.0] * 6), (206, [-0.0] * 6)]
    vectors += [(300 + i, [float(i), -float(i * i)]) for i in range(7)] + [(400, [1.5, 2.5, 3.5])] + [(401, [1.5, 2.5, 3.5])]
    df = spark.createDataFrame([(*v, "x") for v in vectors], "vec_id long, embedding array<double>, n string").repartition(4)
    rows = whitened(df, vectors)
    check_whitening(vectors, rows)
    assert {(r.vec_id, r.whitened, r.explained) for r in rows if r.vec_id in (400, 401)} == {(400, 0.0, 0.0), (401, 0.0, 0.0)}


def test_whitening_of_large_integers_is_exact(spark):
    """Entries at which n * x, or its square, leaves 64 bits."""
    for power in (20, 40, 52):
        vectors = [(i, [float((i * 7919 + d * 104729) % 1000 - 500) * 2.0**power for d in range(3)]) for i in range(30)]
        df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
        rows = whitening.whiten(df, 2).collect()
        xs = {i: [math.floor(256 * c) for c in v] for i, v in vectors}
        xs = {i: [max(-(1 << 63), min((1 << 63) - 1, c)) for c in x] for i, x in xs.items()}
        fit = {tuple(x) for x in xs.values()}
        sums = [sum(c) for c in zip(*fit, strict=True)]
        exact = {i: sum((len(fit) * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for i, x in xs.items()}
        assert len(rows) == 60 and all(r.identity_error < 1e-4 for r in rows)
        if power < 52:
            assert {r.vec_id: int(r.deviation) for r in rows} == exact
        else:  # past 38 digits there is no decimal
            assert all(r.deviation is None or int(r.deviation) == exact[r.vec_id] for r in rows)


def test_whitening_of_nothing(spark):
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect() == []


def test_the_given_vectors_are_white(spark):
    rows = registry.op13_whitening(spark, SF).collect()
    by = {k: np.array([r.whitened for r in rows if r.component == k]) for k in (1, 2, 3, 4)}
    cov = np.cov(np.stack([by[k] for k in by]), bias=True)
    assert np.abs(cov - np.eye(4)).max() < 1e-9  # no vector is there twice
    assert {r.identity_error <= 1e-9 for r in rows} == {True}
    shares = [next(r.explained for r in rows if r.component == k) for k in by]
    assert shares == sorted(shares, reverse=True) and 0 < sum(shares) < 1
