import collections
import random

import numpy as np

import corpus_pipeline
from inkveil.llm import pieces, stages, vector_search
from inkveil.llm.quality_rules import piece_model

SF = "/root/testdata/sf0.001"


def check_search(df, rows, k=10, by=100, recall=0.9, **options):
    good = [(i, v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    got = collections.defaultdict(list)
    for r in vector_search.nearest(df, k=k, queries_by=by, **options).collect():
        got[r.query_id].append((r["rank"], r.score, r.vec_id))
    found = wanted = 0
    queries = [i for i, _ in good if i % by == 0]
    assert set(got) <= set(queries)
    for q, v in ((i, v) for i, v in good if i % by == 0):
        others = [(float(np.sqrt(((np.array(w, float) - np.array(v, float)) ** 2).sum())), i) for i, w in good if i != q and len(w) == len(v)]
        want = sorted(others)[:k]
        mine = sorted(got[q])
        assert [x[0] for x in mine] == list(range(1, len(want) + 1))
        assert [(s, i) for _, s, i in mine] == sorted((s, i) for _, s, i in mine)
        by_id = {i: s for s, i in others}
        assert all(by_id[i] == s for _, s, i in mine)
        found += len({i for _, _, i in mine} & {i for _, i in want})
        wanted += len(want)
    assert found >= recall * wanted


def test_search_recall_on_the_table(spark):
    """At the query's own settings; and in several parts and turns; with all reranked it is exact."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    check_search(df, rows)
    check_search(df, rows, part=300, turn=5)
    check_search(df, rows, recall=1.0, share=1.0, part=300, turn=5)


def test_search_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 4)]) for i in range(60)]
    rows += [(200 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(40)] + [(100, [1.0, 2.0, 3.0, 4.0])]
    rows += [(500, None), (501, []), (502, [0.0] * 4), (503, [None, 1.0, 1.0, 1.0]), (504, [float("nan")] * 4), (600, [1.0, 2.0]), (601, [1.0, 3.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    clean = [(r.vec_id, r.embedding) for r in df.collect()]
    check_search(df, clean, recall=1.0, share=1.0)
    assert vector_search.nearest(df.limit(0)).count() == 0


def test_index_finds_all_when_all_are_candidates():
    rng = np.random.default_rng(0)
    v = rng.normal(0, 1, (300, 8))
    index = vector_search.Index(v, v[:32], 16)
    d, some = index.search(v[5], 4, 300)
    want = vector_search.brute_nearest(np.arange(300), v, [5], 3)[5]
    assert sorted(zip(d.tolist(), some.tolist(), strict=True))[1:] == want


def test_the_nearest_is_found_beside_the_query_itself(spark):
    v = np.random.default_rng(1).normal(0, 1, (300, 4))
    rows = vector_search.nearest(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), k=1, queries_by=1).collect()
    want = vector_search.brute_nearest(np.arange(300), v, list(range(300)), 1)
    assert {r.query_id: r.vec_id for r in rows} == {q: found[0][1] for q, found in want.items()}


ODD = [None, "", " ", "  a", "a ", "▁", "x▁y ▁ z", "\n\n", "é😀\u0000 z", "中文 字", "a\tb\r\n", "word" * 5000, " \n "]


def test_pieces_equal_the_library(spark):
    library, encoder = piece_model(None), pieces.encoder(None)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rng = random.Random(3)
    texts += ["".join(rng.choice("ab the中é😀ing0\n ") for _ in range(300)) for _ in range(20)]
    for t in [*texts, *ODD]:
        if t and "▁" not in t:
            assert encoder.encode(t) == library.encode(t)
        assert encoder.decode(encoder.encode(t)) == (t or "")


def test_texts_that_begin_alike_are_searched_on():
    """Whatever was searched before, and with a memory that starts over all the time."""
    library, vocabulary = piece_model(None), pieces.encoder(None).vocabulary
    rng = random.Random(8)
    stem = "thenationalin" * 12
    texts = [stem[: rng.randrange(1, len(stem))] + "".join(rng.choice("aehinst") for _ in range(rng.randrange(60))) for _ in range(120)]
    texts += [stem * 9, stem * 9 + "s", stem, stem[:20], stem * 9]
    for order in (texts, sorted(texts), sorted(texts, reverse=True)):
        e = pieces.Encoder(vocabulary, most=20_000)
        for few in (order[:60], order[60:]):
            assert [np.frombuffer(p, np.int32).tolist() for p in e.packed(few)] == [library.encode(t) for t in few]
        assert e.packed(["", None]) == [b"", b""] and e.packed([]) == []


def test_window_commits_before_the_end():
    encoder, library = pieces.encoder(None), piece_model(None)
    text = "thenationalin" * 400
    parts = list(encoder.stream("▁" + text))
    assert len(parts) > 20 and max(map(len, parts)) < 200
    assert [x for p in parts for x in p] == library.encode(text)


def test_encoded_table(spark):
    docs = spark.createDataFrame([(i, t, "ids") for i, t in enumerate(ODD)] + [(None, "twice", "x")] * 2, "doc_id long, text string, ids string")
    out = pieces.encode(docs)
    rows = out.collect()
    assert len(rows) == len(ODD) + 2 and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    back = {r.doc_id: r.text for r in pieces.decode(out).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(ODD))
    assert pieces.encode(docs.limit(0)).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_join", "pii", "mixing", "pieces"]
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(r.round_trip for r in rows)
    counts = collections.Counter(r.doc_id for r in rows)
    assert set(counts) <= {r.doc_id for r in docs.collect()} and max(counts.values()) <= 3


def test_one_of_each_group_stays(spark):
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(5, base), (3, base + " end"), (9, base), (3, base + " end"), (7, "other text"), (None, "no id"), (8, None), (8, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = stages.drop_near_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, base + " end"), (7, "other text"), (None, "no id"), (8, None), (8, "")], key=str)


def test_a_vector_that_many_queries_have(spark):
    """Its rows are queries of their own, and their nearest are its other rows."""
    rows = [(100 * i, [1.0, 2.0, 3.0]) for i in range(300)] + [(7, [1.0, 2.0, 4.0]), (8, [5.0, 5.0, 5.0]), (200_000, [-1.0, 0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    found = {}
    for r in vector_search.nearest(df, k=3).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert len(found) == 301 and all(len(v) == 3 for v in found.values())
    assert sorted(found[0]) == [(1, 100, 0.0), (2, 200, 0.0), (3, 300, 0.0)] and sorted(found[200]) == [(1, 0, 0.0), (2, 100, 0.0), (3, 300, 0.0)]
    assert [v for _, v, _ in sorted(found[200_000])] == [0, 100, 200]


def test_results_do_not_follow_the_sessions_partitions(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    held = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in ("3", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(map(tuple, vector_search.nearest(df).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert found[0] == found[1] and found[0]
