"""What moves between tasks: words of images and pages at most once, and found again as loose or as packed."""

import random

from pyspark.sql import functions as F

from __spark_entry__ import SMOKE_DIR, queries
from inkveil.operators import images, layout
from inkveil.operators.matching import box_counts, ocr_matches, packed, rects, term_hits


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_words_are_moved_once(spark):
    # packed and made distinct; to its page; the words are in their row, and only the terms may meet them by key
    for name, most in (("plate_boxes", 2), ("reading_order", 1), ("ocr_box_match", 3)):
        assert exchanges(queries()[name](spark, SMOKE_DIR)) <= most, name


def test_places_of_own_terms_equal_plain_loops(spark):
    rng = random.Random(3)
    said = {i: [rng.choice(["ab", "Cd,", "--", "ab's", "e"]) for _ in range(rng.randrange(40))] for i in range(12)}
    wanted = [(i, 10 * i + k, " ".join(rng.choice(["ab", "cd", "e"]) for _ in range(k + 1))) for i in range(12) for k in range(4)]
    plain = {"ab": "ab", "Cd,": "cd", "--": None, "ab's": "ab's", "e": "e"}
    want = set()
    for image, term, text in wanted:
        kept = [(at, plain[w]) for at, w in enumerate(said[image]) if plain[w]]
        ws = text.split()
        for s in range(len(kept) - len(ws) + 1):
            if [w for _, w in kept[s : s + len(ws)]] == ws:
                want |= {(image, term, s, at, float(at)) for at, _ in kept[s : s + len(ws)]}
    rows = [(i, at, w, (float(at),)) for i, ws in said.items() for at, w in enumerate(ws)]
    words = spark.createDataFrame(rows, "image_id int, at int, text string, box struct<x0:double>").repartition(5)
    terms = spark.createDataFrame(wanted, "image_id int, term_id long, term string")
    for form in (words, packed(words)):
        assert {(r.image_id, r.term_id, r.start, r.at, r.box.x0) for r in ocr_matches(form, terms).collect()} == want
    assert ocr_matches(packed(words), terms.drop("image_id").filter("term_id < 4")).count() > 0


def test_packed_words_are_those_of_ocr_words(spark):
    page = "named_struct('lines', array(named_struct('words', transform(split(t, ' '), (w, i) -> named_struct('text', w, 'polygon', transform(sequence(0, 3), k -> named_struct('x', 10 * i + k, 'y', k)))))))"
    pages = spark.sql(f"SELECT id AS image_id, array({page}, {page}) AS blocks FROM (SELECT id, concat('a b', id) AS t FROM range(5))")
    loose = images.ocr_words(pages).select("image_id", "at", "text", F.struct("x0", "y0", "x1", "y1").alias("box"))
    assert images.ocr_packed(pages).select("image_id", F.inline("words")).exceptAll(loose).count() == 0
    assert images.ocr_packed(pages).select(F.inline("words")).count() == loose.count() == 20


def test_word_starts_of_lines(spark):
    rows = spark.createDataFrame([(["ab", "c", "def"],), ([],), (["é"],)], "words array<string>")
    assert [r.at for r in rows.select(layout.word_starts(F.col("words")).alias("at")).collect()] == [[0.0, 3.0, 5.0], [], [0.0]]


def test_boxes_are_counted_where_they_are_found(spark):
    texts = ["one two\nthree\n\n--\nfour one", "two three-four\nfive", "two three-\nfour\nfive one's", "", None, "… one two\nthree four"]
    docs = spark.createDataFrame([(i % 5, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    said = ["one", "two three four one", "three-four five", "two three", "none of it", "…", "one"]
    terms = spark.createDataFrame([(str(k), t) for k, t in enumerate(said)], "term_id string, term string")
    want = {(r.term_id, r["count"]) for r in rects(docs, terms).groupBy("term_id").count().collect()}
    counts = box_counts(docs, terms)
    assert {(r.term_id, r.boxes) for r in counts.collect()} == want and ("1", 3) in want
    assert {(r.term_id, r.hits) for r in term_hits(terms, counts).collect()} == want | {("4", 0), ("5", 0)}
    for name in ("term_hits", "unapplied_terms", "rule_summary"):
        assert "explode(spans" not in queries()[name](spark, SMOKE_DIR)._jdf.queryExecution().toString(), name


def test_words_of_images_without_a_string_are_not_looked_at(spark):
    rows = [(i, f"ann{i}@b.com to\nall" if i % 10 == 0 else f"nothing here of {i}\nat all") for i in range(60)]
    docs = spark.createDataFrame([*rows, (60, None), (61, ""), (62, "lost ann0@b.com")], "image_id long, text string").repartition(4)
    shown = docs.selectExpr("image_id", "9 AS width", "9 AS height", "CASE WHEN image_id = 62 THEN 'timeout' END AS error")
    box = F.struct(*[F.lit(float(k)).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))])
    word = F.transform(F.split("text", "[ \n]"), lambda w, i: F.struct(i.alias("at"), w.alias("text"), box.alias("box")))
    words = docs.filter("text IS NOT NULL").select("image_id", word.alias("words"))
    rule = {"name": "t", "call": lambda chunk: ([w for w in chunk.split() if "@" in w], 1, 1)}
    asked = []

    def of(some):
        asked.extend(r.image_id for r in some.collect())
        return words.join(some, "image_id", "left_semi")

    said = docs.select("image_id", F.translate("text", "\n", " ").alias("text"))
    want = {(i, f"ann{i}@b.com") for i in range(0, 60, 10)} | {(62, images.FAILED)}
    for form, texts in ((words, None), (words.select("image_id", F.inline("words")), None), (of, said)):
        boxes, calls = images.image_text(shown, form, rule, texts=texts)
        assert {(r.image_id, r.name) for r in boxes.collect()} == want and calls.count() == 60
        plan = boxes._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.split("\n") if "Exchange hashpartitioning(image_id" in x and "words" in x]
    assert sorted(asked) == list(range(0, 60, 10))
