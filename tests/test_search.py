"""The locator and the substring search against plain loops, on long words, and by document."""

import random
import re
import time

import pyarrow as pa
import pytest

from inkveil.operators import locator, matching

NORMAL = re.compile(r"[ \t]+")


def words_of(text):
    strip = lambda w: w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    return [w for w in (strip(w) for w in strip((text or "").lower()).split(" ")) if w]


def brute_places(text, term):
    """Places of a term, word by word: (start, n)."""
    lines = [ws for ws in map(words_of, (text or "").split("\n")) if ws]
    at = [(w, i) for i, ws in enumerate(lines) for w in ws]
    ws = words_of(term)
    stem = lambda t: t.rstrip("s").rstrip("'")
    readings = [(ws, -1)] + [([*ws[:i], w[:k], w[k + 1 :], *ws[i + 1 :]], i) for i, w in enumerate(ws) for k in range(1, len(w) - 1) if w[k] == "-"]
    out = []
    for number, (own, split) in enumerate(readings):
        n = len(own)
        for s in range(len(at) - n + 1) if n else ():
            ok = True
            for k, w in enumerate(own):
                t, line = at[s + k]
                same = line == at[s][1]
                if n == 1:
                    good = t in (w, w + "'s")
                elif split >= 0 or not same:
                    good = t == w
                else:
                    good = t == w or stem(t) == w or (len(w) >= 4 and t != w and ((k == 0 and t.endswith(w)) or (k == n - 1 and t.startswith(w))))
                ok &= good
            if ok and (split < 0 or at[s + split][1] < at[s + split + 1][1]):
                out.append((number, s, n))
    return sorted(out)


def some_texts(rng):
    stems = ["ann", "lee", "leeds", "smith", "smiths", "boss's", "co-op", "co", "op", "mary-jane", "mary", "jane", "smithson", "hughsmith", "the", "s", "''", "a-b-c", "a", "b-c", "a-b", "c"]
    return ["\n".join(" ".join(rng.choices(stems, k=rng.randrange(9))) for _ in range(rng.randrange(1, 9))) for _ in range(25)], [" ".join(rng.choices(stems, k=rng.choice((1, 2, 2, 3, 4)))) for _ in range(60)]


@pytest.mark.parametrize("seed", [1, 2])
def test_places_equal_plain_loops(spark, seed):
    texts, terms = some_texts(random.Random(seed))
    docs = spark.createDataFrame(list(enumerate([*texts, None, ""])), "doc_id long, text string").repartition(3)
    sought = spark.createDataFrame(list(enumerate([*terms, "", " ... "])), "term_id long, term string")
    want = sorted((d, t, *p) for d, text in enumerate(texts) for t, term in enumerate(terms) for p in brute_places(text, term))
    rows = lambda df: sorted((r.doc_id, r.term_id, r.reading, r.start, r.n) for r in df.collect())
    assert len(want) > 200
    assert rows(matching.places(docs, sought)) == want
    assert rows(matching.places(docs, sought, blocks=3)) == want
    wanted = spark.createDataFrame([(d, t, term) for d in range(len(texts)) for t, term in enumerate(terms) if (d + t) % 4 == 0], "doc_id long, term_id long, term string")
    assert rows(matching.places_of(docs, wanted)) == [w for w in want if (w[0] + w[1]) % 4 == 0]


def test_candidates_are_judged_in_parts(monkeypatch):
    texts, terms = some_texts(random.Random(3))
    table = locator.Terms([{"term_id": i, "readings": [{"ws": words_of(t), "split": -1}]} for i, t in enumerate(terms) if words_of(t)])
    page = locator.Page(pa.array([[ws for ws in map(words_of, t.split("\n")) if ws] for t in texts], pa.list_(pa.list_(pa.string()))))
    whole = table.search(page.distinct, page.ids, page.first, page.line)
    monkeypatch.setattr(locator, "TOGETHER", 7)
    parts = table.search(page.distinct, page.ids, page.first, page.line)
    assert sorted(zip(*(x.tolist() for x in whole), strict=True)) == sorted(zip(*(x.tolist() for x in parts), strict=True))


def test_long_words_cost_no_more_than_their_reading(spark):
    """A word of a megabyte among terms of all lengths, for the locator and the prefilter."""
    long_ = "".join(random.Random(1).choices("abcdefgh", k=1 << 20))
    docs = spark.createDataFrame([(1, f"met John Smith {long_} and {long_[:5000]}smith\nJohn Smiths"), (2, long_)], "doc_id long, text string")
    terms = spark.createDataFrame([(1, "John Smith"), (2, f"{long_[:40]} Smith"), (3, long_[5:25]), (4, f"and {long_[:5]}")], "term_id long, term string")
    began = time.perf_counter()
    assert sorted((r.term_id, r.start) for r in matching.places(docs, terms).collect()) == [(1, 1), (1, 6), (4, 4)]
    pages = docs.selectExpr("doc_id", "0 AS page_no", "text AS raw_text", "CAST(NULL AS STRING) AS next_text")
    assert sorted((r.doc_id, r.term_id) for r in matching.prefilter(pages, terms).collect()) == [(1, 1), (1, 3), (1, 4), (2, 3)]
    assert time.perf_counter() - began < 20


def test_nothing_runs_while_a_plan_is_built(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    terms = spark.createDataFrame([(1, "a b")], "term_id long, term string")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    df, pairs = matching.rects(docs, terms), matching.prefilter(docs.selectExpr("doc_id", "0 AS page_no", "text AS raw_text", "CAST(NULL AS STRING) AS next_text"), terms)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup() == before
    assert df.count() == 1 and pairs.count() == 1


def test_too_many_terms_are_told_of(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    terms = spark.createDataFrame([(i, f"word{i} b") for i in range(100)], "term_id long, term string")
    with pytest.raises(Exception, match="deal them into blocks"):
        matching.places(docs, terms, most=1000).collect()
    assert matching.places(docs, terms, most=1000, blocks=8).collect() == []


def test_nothing_to_find_or_to_look_at(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, "a")], "doc_id long, text string")
    none, terms = spark.createDataFrame([], "term_id string, term string"), spark.createDataFrame([("x", "a")], "term_id string, term string")
    assert matching.places(docs, none).collect() == []
    assert matching.places(docs.limit(0), terms).collect() == []
    assert sorted((str(r.doc_id), r.term_id, r.word) for r in matching.places(docs, terms).collect()) == [("1", "x", "a"), ("None", "x", "a")]
    held = docs.selectExpr("doc_id", "array(text, NULL, text) AS forms")
    strings = spark.createDataFrame([("x", "a"), ("y", " "), ("z", None), ("w", "a b"), ("v", "a")], "name string, s string")
    assert sorted((str(r.doc_id), r.name) for r in matching.containing(held, ["doc_id"], "forms", strings, "name", "s").collect()) == [("1", "v"), ("1", "w"), ("1", "x"), ("None", "v"), ("None", "x")]
