"""Terms located in documents, against a search word by word; and the stages of a processor."""

import re

import pytest
from pyspark.sql import functions as F

from inkveil.operators import detect, images, jobs, matching, metrics, processor
from inkveil.plans.text_queries import TRUTH


def boxes(spark, text, term):
    docs, terms = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, term)], "term_id long, term string")
    return sorted((r.line_no, r.first, r.last) for r in matching.word_spans(docs, terms).collect())


def test_every_stated_case_goes_through_the_locator(spark):
    docs = spark.createDataFrame([(i, line) for i, (line, _, _) in enumerate(TRUTH)], "doc_id long, text string")
    terms = spark.createDataFrame([(i, term) for i, (_, term, _) in enumerate(TRUTH)], "term_id long, term string")
    found = {(r.doc_id, r.term_id) for r in matching.rects(docs, terms).collect()}
    assert {i for i in range(len(TRUTH)) if (i, i) in found} == {i for i, (_, _, e) in enumerate(TRUTH) if e}


@pytest.mark.parametrize(
    ("text", "term", "want"),
    [
        ("the John Smiths came", "John Smith", [(0, 1, 2)]),
        ("somethingMonica Cowan", "Monica Cowan", [(0, 0, 1)]),
        ("by Mary Hugh-\nWilliams here", "Mary Hugh-Williams", [(0, 1, 2), (1, 0, 0)]),
        ("Hugh-\nWilliams", "Hugh-Williams", [(0, 0, 0), (1, 0, 0)]),
        ("a-b-\nc and a-\nb-c", "a-b-c", [(0, 0, 0), (1, 0, 0), (1, 2, 2), (2, 0, 0)]),
        ("This\nis line\nbroken", "This is line broken", [(0, 0, 0), (1, 0, 1), (2, 0, 0)]),
        ("Hello\nWorlds", "Hello World", []),
        ("Hellos\nWorld", "Hello World", [(0, 0, 0), (1, 0, 0)]),
        ("Hello\nYou", "Hello World", []),
        ("christine watts-hughgeneva", "Christine Watts-Hugh", [(0, 0, 1)]),
        ("xMonica Cowanx alphaMonica Cowanbeta", "Monica Cowan", [(0, 0, 1), (0, 2, 3)]),
        ("Hugh Williams", "Hugh-Williams", []),
        ("a a a", "a a", [(0, 0, 1), (0, 1, 2)]),
        ("", "a", []),
        (None, "a", []),
        ("x", "", []),
        ("smiths smith's smith", "smith", [(0, 1, 1), (0, 2, 2)]),
    ],
)
def test_places(spark, text, term, want):
    assert boxes(spark, text, term) == want


def test_prefilter_loses_nothing(spark):
    texts = ["met (John Smith) today", 'said "Hello World', "a\tJohn Smith", "superJohn Smithson", "Hugh-\nWilliams", "cut hy-\nphen here", "x", "", None, "two  spaces wide"]
    sought = ["John Smith", "Hello World", "Hugh-Williams", "hyphen here", "phen", "x", "two spaces", "smith", "an", "Williams", " "]
    pages = spark.createDataFrame([(i, 0, t, None) for i, t in enumerate(texts)], "doc_id long, page_no int, raw_text string, next_text string")
    terms = spark.createDataFrame(list(enumerate(sought)), "term_id long, term string")
    found = {(r.doc_id, r.term_id) for r in matching.prefilter(pages, terms).collect()}
    flat = lambda t: t.replace("\n", " ").replace("  ", " ")
    want = set()
    for i, t in enumerate(texts):
        for j, s in enumerate(sought):
            s = re.sub(r"\s+", " ", s).strip()
            if s and any(s in flat(f) for f in ((t or ""), (t or "").replace("-\n", "-"), (t or "").replace("-\n", ""))):
                want.add((i, j))
    assert found == want and len(want) == 10


def test_processor_stages(spark):
    docs = spark.createDataFrame([(1, "This is the mail of the man: ann@b.com and it is for you\nann@b.com"), (2, "Der Mann und die Frau sind nicht im Haus auf dem Berg x@y.de"), (3, None)], "doc_id long, text string")
    files = processor.processor("text")
    proposed, status = files.analyse(docs)
    assert {(r.doc_id, r.status, r.n_terms, r.n_boxes) for r in status.collect()} == {(1, "ANALYSED", 1, 2), (2, "BLOCKED", 0, 0), (3, "ANALYSED", 0, 0)}
    lines, done = files.redact(docs, proposed)
    assert {(r.doc_id, r.status) for r in done.collect()} == {(1, "SUCCESS"), (2, "FAIL"), (3, "FAIL")}
    assert "ann" not in " ".join(r.text for r in lines.filter("doc_id = 1").collect())
    with pytest.raises(processor.UnknownProcessor):
        processor.processor("none")
    with pytest.raises(processor.DuplicateProcessor):
        type("Again", (processor.Processor,), {"file_kind": "text"})
    marks = spark.createDataFrame([(1, 8), (1, 12), (2, None)], "doc_id long, kind int")
    assert processor.proposed_annotations(marks).count() == 1 and processor.final_annotations(marks).count() == 2


def test_chunked_service(spark):
    docs = spark.createDataFrame([(1, "x@y " * 3000), (2, "bad word"), (3, None), (4, "")], "doc_id long, text string")

    def call(chunk):
        if chunk.startswith("bad"):
            raise OSError("refused")
        return [w for w in chunk.split() if "@" in w], len(chunk.split()), 1

    proposals, calls = detect.chunked_service(docs, {"name": "s", "call": call})
    assert [tuple(r) for r in proposals.collect()] == [(1, "s", 0, "x@y")]
    rows = calls.collect()
    assert sum(r.error is not None for r in rows) == 1 and sum(r.prompt_tokens for r in rows) >= 1500


def test_images_fail_closed(spark):
    asked = spark.createDataFrame([(1, 10, 5), (2, 10, 5), (3, 10, 5)], "image_id long, width int, height int")
    results = spark.createDataFrame([(1, (1.0, 1.0, 2.0, 2.0), None), (2, None, "busy")], "image_id long, box struct<x0:double,y0:double,x1:double,y1:double>, error string")
    assert {(r.image_id, r.name, tuple(r.box)) for r in images.detected(asked, results, "Face").collect()} == {(1, "Face Detected", (1.0, 1.0, 2.0, 2.0)), (2, "Face Detection Failed", (0.0, 0.0, 10.0, 5.0))}
    with pytest.raises(Exception, match="unknown image"):
        images.detected(asked.filter("image_id > 1"), results, "Face").collect()
    rows = spark.createDataFrame([(1, 0, "a", (5.0, 5.0, 1.0, 1.0)), (1, 0, "b", (1.0, 1.0, 1.0, 9.0)), (1, 0, "c", None)], "doc_id long, page_no int, name string, box struct<x0:double,y0:double,x1:double,y1:double>")
    good, bad = images.image_highlights(rows)
    assert [(r.title, r.left, r.right) for r in good.collect()] == [("Image Redaction", 1.0, 5.0)] and bad.count() == 2
    scored = spark.createDataFrame([(1, 0.912345, 1.239, 1.0, 2.0, 2.0), (1, 0.2, 1.0, 1.0, 2.0, 2.0)], "image_id long, score double, x0 double, y0 double, x1 double, y1 double")
    assert [(r.score, r.box.x0) for r in images.signature_rows(scored).collect()] == [(0.9123, 1.24)]
    some = spark.createDataFrame([(None, 10, 60, 60), ("b", 10, 60, 60), ("b", 10, 10, 60)], "bbox string, n_bytes long, width int, height int")
    assert images.usable_images(some).count() == 1


def test_small_tools(spark):
    into = {}
    with metrics.wall_time(into, "x"), metrics.MemorySnapshots(0.01) as seen:
        sum(range(10**5))
    assert into["x"] >= 0 and len(seen.taken) >= 2 and min(seen.taken) > 1
    row = spark.range(1).select(jobs.unique_id(F.lit("a"), F.lit(7)).alias("u"), jobs.today().alias("d")).first()
    assert row.u == "a-7" and re.fullmatch(r"\d{4}-\d\d-\d\d", row.d)
