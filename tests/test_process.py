"""The steps of a document's processing: letters taken in the task, one reading for all patterns, boxes counted a text."""

from pyspark.sql import functions as F

from inkveil.operators import detect, language, layout, masking

SF = "/root/testdata/sf0.001"
SPANS = [(1, 0, 0, 1), (1, 0, 1, 1), (1, 1, 1, 99), (1, 9, 0, 0), (1, -1, 0, 0), (1, 0, None, 1), (1, None, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0), (4, 0, -5, 0), (4, 1, 1, 0), (None, 0, 0, 0), (5, 0, 1, 1), (9, 0, 0, 0)]
TEXTS = [(1, "one two three\n ! \nfour — five  six"), (2, None), (3, ""), (4, "“a” b\nc d"), (5, "x"), (5, "x y z"), (None, "x"), (6, "nothing")]


def optimised(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_letters_of_the_task_equal_those_of_the_plan(spark):
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"aq{chr(c)}z" for c in every[i : i + 2048]) for i in range(0, len(every), 2048)]
    texts += ["", " ", "a", " a ", "..", "İ", "İİ x", "x  İ", "éÉ", "\n\nab.c--", "", "abc"]
    plan = dict(spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", language.letters(F.col("t"))).collect())
    codes, low, n = language.spelled(texts)
    for i in range(len(texts)):
        assert n[i] == max(0, len(plan[i]) - 2)
        if n[i]:
            assert "".join(language.ALPHABET[c] for c in codes[low[i] : low[i] + n[i] + 2]) == plan[i]


def test_shares_equal_sums_over_the_trigrams_of_the_plan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs, most=40)
    logs = {r.gram: r.logs for r in model.collect()}
    spelt = dict(docs.select("doc_id", language.letters(F.coalesce("text", F.lit("")))).collect())
    for r in language.with_shares(docs, model).collect():
        s = spelt[r.doc_id]
        grams = [logs.get(s[i : i + 3], logs[""]) for i in range(len(s) - 2)]
        if grams:
            mean = [sum(g[c] for g in grams) / len(grams) * min(len(grams), language.EVIDENCE) for c in range(4)]
            powers = [2.718281828459045 ** (m - max(mean)) for m in mean]
            assert all(abs(p / sum(powers) - r.shares[c]) < 1e-9 for p, c in zip(powers, language.LANGUAGES, strict=True))


def test_long_enough_is_told_of_whole_texts(spark):
    texts = ["", "a b", "a b cdefghijklmnop", "a b cdefghijklmnopq", " " * 900 + "a b cdefghijklmnopq", "a" * 900 + " b", "a" * 900 + " b\t\nc", " \n" * 500 + "a b c", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", language.long_enough(F.col("t"), 20, 3)).collect()
    assert dict(rows) == {i: None if t is None else len(" ".join(t.split())) >= 20 and len(t.split()) >= 3 for i, t in enumerate(texts)}


def test_the_sample_is_read_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    assert optimised(language.fit(docs)).count("Relation [") == len(language.LANGUAGES)


def test_patterns_share_one_reading(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rules = [{"kind": "pattern", "name": n, "pattern": n} for n in detect.PATTERNS] + [{"kind": "plate", "name": "plates"}, {"kind": "dictionary", "name": "words", "words": ["The", "of"]}]
    plan = optimised(detect.detect(docs, rules))
    assert plan.count("Relation [") == 1 and plan.count("regexp_extract_all") == len(detect.PATTERNS) + 2
    rows = lambda df: sorted(map(tuple, df.collect()))
    apart = [rows(detect.detect(docs, [r])) for r in rules]
    assert rows(detect.detect(docs, rules)) == sorted(x for rs in apart for x in rs) and all(apart[:4])


def test_what_a_pattern_needs_is_in_its_matches(spark):
    said = {"email": "a@b.co", "phone": "+1 (212) 555-0100", "ip": "1.2.3.4", "secret": f'token = "{"0a" * 20}"', "licence": "This work is licensed under the MIT", "url": "http://a.b"}
    assert set(said) == set(detect.NEEDED)
    docs = spark.createDataFrame([(1, "\n".join(said.values())), (2, None), (3, "none")], "doc_id long, text string")
    found = {(r.doc_id, r.rule_name): r.term for r in detect.detect(docs, [{"kind": "pattern", "name": n, "pattern": n} for n in said]).collect() if r.ordinal == 0}
    assert found == {(1, n): t for n, t in said.items()}


def test_boxes_counted_a_text_equal_boxes_applied_to_lines(spark):
    docs, boxes = spark.createDataFrame(TEXTS, "doc_id long, text string"), spark.createDataFrame(SPANS, "doc_id long, line_no int, first int, last int")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    counted = masking.boxes_status(docs, boxes)
    assert rows(counted) == rows(masking.redaction_status(docs, masking.apply_redactions(docs, boxes, layout.lines(docs))))
    assert (1, 4, "SUCCESS") in rows(counted)
    assert rows(masking.boxes_status(docs, boxes.limit(0))) == rows(masking.redaction_status(docs, masking.apply_redactions(docs, boxes.limit(0), layout.lines(docs))))
    assert "Generate" not in optimised(counted)
