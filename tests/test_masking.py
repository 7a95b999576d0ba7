"""Terms that are applied where they are found, and words that are taken in the task."""

from pyspark.sql import functions as F

from inkveil.operators import layout, locator, masking, matching
from inkveil.plans import registry

TEXTS = [
    (1, "Mary Hugh-\nWilliams met John Smiths.\n\n  ! \nJohn Smith's house"), (2, None), (3, ""), (4, "!\tjohn smith\x1f .\r\n\x0b(John)  Smith"), (5, "Ünal ÉTÉ İzmir John — Smith “John” John's"),
    (6, "John Smith … JOHN SMITH　john smith"), (7, "$ + john_ <smith> ~john"), (8, "nothing here"), (9, "alpha johnsmith xjohn smithy"),
]


def _tables(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string"), spark.createDataFrame([(1, "John Smith"), (2, "john"), (3, "Mary Hugh-Williams"), (4, "ÉTÉ İzmir")], "term_id long, term string")


def test_masked_where_found_equals_boxes_applied(spark):
    docs, terms = _tables(spark)
    boxes = matching.word_spans(docs, terms).select("doc_id", "line_no", "first", "last")
    applied = masking.apply_redactions(docs, boxes, layout.lines(docs))
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(matching.masked_lines(docs, terms)) == rows(applied.select("doc_id", "line_no", "text", "n_masked"))
    assert rows(masking.terms_status(docs, terms)) == rows(masking.redaction_status(docs, applied))
    assert rows(masking.terms_status(docs.limit(0), terms)) == []


def test_words_of_the_task_equal_those_of_the_plan(spark):
    docs, _ = _tables(spark)
    for _, texts, lines, all_lines in docs.select("doc_id", *matching.texts_or_lines(F.col("text")), matching.lines_of_words(F.col("text"))).collect():
        assert (locator.plain_lines(texts) if texts is not None else lines or []) == all_lines


def test_masking_of_terms_moves_no_lines(spark):
    for name in ("redaction_status", "apply_redactions"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate [doc_id" not in plan


def test_words_are_counted_in_the_task(spark):
    docs, _ = _tables(spark)
    docs = docs.unionByName(spark.createDataFrame([(1, "mary once more, mary"), (None, "mary john"), (None, "mary")], docs.schema))
    plain = layout.tokens(docs).groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.min("gpos").alias("first_at"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(matching.word_index(docs)) == rows(plain)
    plan = registry.queries()["word_index"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
