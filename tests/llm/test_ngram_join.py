import re

import numpy as np
import pytest

from inkveil.llm.ngram_join import grams, marks, ngram_join, schemes
from inkveil.llm.prefix_tree import brute_links, trie_links

SF = "/root/testdata/sf0.001"


def brute(rows, n, percent):
    """(doc_id, set size, component, links) by comparing all pairs."""
    def grams_of(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lower)
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    sets = [grams_of(t) for _, t in rows]
    top, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                top[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if find(k) == find(i) and rows[k][0] is not None]
        out.append((d, len(sets[i]), min(ids, default=None) if sets[i] else d, links[i]))
    return sorted(out, key=str)


def run(spark, rows, n, percent):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, n_shingles string, root int")
    return sorted(map(tuple, ngram_join(docs, n, percent).drop("text_hash").collect()), key=str)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_all_documents_equal_brute_force(spark, n, percent):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, ngram_join(docs, n, percent).drop("text_hash").collect()), key=str) == brute(rows, n, percent)


def test_edges_of_the_input(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "A"), (6, "a b"), (7, "a b"), (7, "a b"), (None, "a b"), (8, "É"), (9, "é"), (None, "solo text of none"), (10, " ".join(words)), (11, " ".join(words[:-1] + ["x"])), (12, " ".join(words[:200] + ["y"] + words[201:])), (13, " ".join(words * 60))]
    assert run(spark, rows, 3, 90) == brute(rows, 3, 90)


def test_no_rows(spark):
    assert run(spark, [], 3, 90) == []


def test_random_near_copies_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for group in range(6):
        base = [f"g{group}w{x}" for x in rng.integers(0, 500, rng.integers(8, 120))]
        for _ in range(25):
            text = list(base)
            for at in rng.integers(0, len(base), rng.integers(0, 4)):
                text[at] = f"n{rng.integers(0, 50)}"
            rows.append((len(rows), " ".join(text)))
    assert run(spark, rows, 3, 90) == brute(rows, 3, 90)


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_mark(percent):
    """Sets at the edge of the similarity agree in one part at least, at every size."""
    rng = np.random.default_rng(2)
    for size in [*range(1, 60), 100, 333, 1000]:
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
        for bigger in range(len(a), 100 * len(a) // percent + 1):
            extra = rng.integers(0, 1 << 63, bigger).astype(np.uint64)
            shared = -(-(percent * (len(a) + bigger)) // (100 + percent))
            b = np.unique(np.concatenate([rng.permutation(a)[:shared], extra[: bigger - shared]]))
            if len(np.setxor1d(a, b)) and brute_links([a, b], percent):
                assert set(marks(a, percent).tolist()) & set(marks(b, percent).tolist()), (len(a), len(b))


def test_trie_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(60):
        base = np.unique(rng.integers(0, 1 << 40, rng.integers(1, 60)).astype(np.uint64))
        sets = []
        for _ in range(rng.integers(2, 40)):
            keep = base[rng.random(len(base)) > rng.random() * 0.15]
            if len(s := np.unique(np.concatenate([keep, rng.integers(0, 1 << 40, rng.integers(0, 5)).astype(np.uint64)]))):
                sets.append(s)
        for percent in (80, 90):
            for split in (None, len(sets) // 2):
                want = [(i, j) for i, j in brute_links(sets, percent) if split is None or i < split <= j]
                assert sorted(trie_links(sets, percent, split, block=3, step=7)) == want


def test_chunks_lose_no_link(spark, monkeypatch):
    """A candidate component dealt out in many chunks gives the same."""
    import inkveil.llm.ngram_join as module

    monkeypatch.setattr(module, "CHUNK_SETS", 4)
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in range(150)]
    rows = []
    for i in range(60):
        text = list(base)
        for at in rng.integers(0, 150, i % 4):
            text[at] = f"n{i}"
        rows.append((i, " ".join(text)))
    assert run(spark, rows, 3, 90) == brute(rows, 3, 90)


def test_grams_of_few_words():
    assert len(grams(np.zeros(0, np.uint64), 3)) == 0
    assert len(grams(np.arange(2, dtype=np.uint64), 3)) == 1
    assert schemes(5, 90) == ()


def _with_a_line(rng, texts: int, line: int = 10, words: int = 45) -> list[np.ndarray]:
    """Sets of unlike texts that have one line in common."""
    said = rng.integers(0, 1 << 62, line)
    return [np.unique(np.concatenate([said, rng.integers(0, 1 << 62, words - line)]).astype(np.uint64) * np.uint64(4)) for _ in range(texts)]


def test_unlike_sets_with_a_common_line_are_not_one_candidate(spark):
    """The largest group of sets that marks link does not grow with the sets that share a line."""
    rng = np.random.default_rng(7)
    sets = _with_a_line(rng, 1500)
    gram, times = np.unique(np.concatenate(sets), return_counts=True)
    top = list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    seen = {}
    for i, s in enumerate(sets):
        for m in marks(s, 80, gram[times > 5]).tolist():
            top[find(i)] = find(seen.setdefault(m, i))
    assert np.bincount([find(i) for i in range(len(sets))]).max() < 150  # 491 when common n-grams were not told apart


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_mark_whatever_is_common(percent):
    rng = np.random.default_rng(8)
    for size in [*range(1, 60, 3), 100, 333]:
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
        for share in (0.3, 0.9, 1.0):
            shared = -(-(percent * 2 * size) // (100 + percent))
            b = np.unique(np.concatenate([rng.permutation(a)[:shared], rng.integers(0, 1 << 63, size - shared).astype(np.uint64)]))
            common = np.sort(rng.permutation(np.union1d(a, b))[: int(share * len(np.union1d(a, b)))])
            if len(np.setxor1d(a, b)) and brute_links([a, b], percent):
                assert set(marks(a, percent, common).tolist()) & set(marks(b, percent, common).tolist()), (size, share)


def test_common_grams_are_those_of_unlike_texts(spark):
    from inkveil.llm.ngram_join import common_grams

    line = "all rights of this text are held by its author"
    rows = [(f"{line} a{i} b{i} c{i} d{i} e{i} f{i}",) for i in range(9)] + [("one text that is copied often and so not common",)] * 30 + [(None,), ("",)]
    assert len(common_grams(spark.createDataFrame(rows, "text string"), 5)) == 6  # of the line's ten words
