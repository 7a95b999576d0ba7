"""The language model on texts that it was not fitted on, and on odd ones."""

from pyspark.sql import functions as F

from inkveil.operators import detect, language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs, most=40)
    fitted = {r.doc_id for c in language.LANGUAGES for r in docs.filter(F.col("lang") == c).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(40).collect()}
    rows = language.with_shares(docs, model).collect()
    held = [r for r in rows if r.doc_id not in fitted and r.text and len(r.text.split()) >= 3]
    assert len(held) > 700
    assert sum(max(r.shares, key=r.shares.get) == r.lang for r in held) >= 0.99 * len(held)
    assert all(abs(sum(r.shares.values()) - 1) < 1e-9 for r in rows)
    again = {r.doc_id: r.shares for r in language.with_shares(docs, language.fit(docs.repartition(5), most=40)).collect()}
    assert all(abs(again[r.doc_id][c] - r.shares[c]) < 1e-9 for r in rows for c in language.LANGUAGES)


def test_odd_texts_and_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs)
    odd = [(1, None, 1), (2, "", 1), (3, "12 34 !!", 1), (4, "文字 列", 1), (5, "the the the", 1), (6, "\x00🙂" * 30, 1), (7, "a", 1)]
    rows = {r.doc_id: r for r in language.is_language(spark.createDataFrame(odd, "doc_id long, text string, _hits int"), model).collect()}
    assert {k: r.is_english for k, r in rows.items()} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False, 7: False}
    assert rows[1]._hits == 1
    assert language.is_language(docs.limit(0), model).collect() == []
    kept = detect.with_language(spark.createDataFrame(odd, "doc_id long, text string, _hits int"))
    assert kept.columns == ["doc_id", "text", "_hits", "is_english"] and kept.first()._hits == 1
    none = language.fit(docs.limit(0))  # nothing to fit on: all languages alike, nothing passes
    assert {r.is_english for r in language.is_language(docs, none).collect()} == {False}
