"""Language model, classifiers and quality rules."""

import collections
import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F
import pyarrow as pa

from inkveil.llm import common, lm_scoring, quality_classifier, quality_rules, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


MASSES = (100.0, 10.0)


def check_lm(docs, **options):
    """Against counts of words, pairs and triples in dictionaries and the smoothing as it is worded."""
    texts = [(r.doc_id, WORD.findall(lower(r.text))) for r in docs.collect()]
    out_of = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1
    c, pairs, triples = collections.Counter(), collections.Counter(), collections.Counter()
    for d, words in texts:
        if not out_of(d):
            ws = [None, *words, None]
            c.update(ws[1:])
            pairs.update(zip(ws[:-1], ws[1:], strict=True))
            triples.update(zip(ws[:-2], ws[1:-1], ws[2:], strict=True))
    n, v = sum(c.values()), len(c)
    once, twice = (sum(x == k for x in c.values()) for k in (1, 2))
    discount = min(0.95, max(0.05, once / (once + 2 * twice) if once else 0.5))

    def p1(w):
        return (c[w] - discount) / n if c.get(w) else discount * v / n if n else 1.0

    def p2(u, w):
        return (pairs.get((u, w), 0) + MASSES[0] * p1(w)) / (c.get(u, 0) + MASSES[0])

    def p3(t, u, w):
        return (triples.get((t, u, w), 0) + MASSES[1] * p2(u, w)) / (pairs.get((t, u), 0) + MASSES[1])

    grams = {(w,): x for w, x in c.items()} | dict(pairs) | dict(triples)
    automaton = lm_scoring.Automaton(grams, n, discount, MASSES)
    want = collections.Counter()
    for d, words in texts:
        base = sum(math.log10((c.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in [*words, None])
        ws = [None, *words, None]
        score = math.log10(p2(None, ws[1])) + sum(math.log10(p3(*ws[k : k + 3])) for k in range(len(ws) - 2))
        assert math.isclose(automaton.score(words), score, rel_tol=1e-9, abs_tol=1e-12)
        want[d, out_of(d), len(words) + 1, sum(w in c for w in [*words, None]), n, f"{base:.6g}", f"{score:.6g}"] += 1
    rows = lm_scoring.lm_scores(docs, **options).collect()
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, f"{r.base_score:.6g}", f"{r.score:.6g}") for r in rows) == want
    return rows


def test_lm_equals_the_automaton(spark):
    rows = check_lm(spark.read.parquet(f"{SF}/documents.parquet"), block_tokens=20_000)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_of_odd_rows(spark):
    rows = [(0, None), (0, ""), (None, "a b"), (3, "É é A a"), (3, "É é A a"), (4, "w " * 50_000), (7, "unheard of")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    check_lm(docs)
    check_lm(docs.filter("doc_id = 4"))  # read from a table that a shuffle made: settled first
    assert lm_scoring.lm_scores(docs.limit(0)).count() == 0


def test_packing():
    rng = np.random.default_rng(1)
    values = np.sort(rng.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (lm_scoring.unplanes(lm_scoring.planes(values)) == values).all()
    counts = rng.integers(0, 600, 1000)
    assert (lm_scoring.unsmall(lm_scoring.small(counts)) == counts).all()


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, double = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            double += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), double, len(covered), failed


def test_quality_rules_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = quality_rules.quality_rules(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(texts[r.doc_id])
        assert not (r.kept and r.base_failed)
    good = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if r.quality == 1}
    fine = [r for r in rows if r.doc_id in good and not r.base_failed]
    assert sum(r.kept for r in fine) == len(fine)


def test_quality_rules_of_odd_rows(spark):
    texts = [None, "", " \n\t", "a b a b a b a b", "x y\x1cz", "\r\n\r\n", "ｆｕｌｌ 中文 " * 30, "w" * 300_000, "# " * 100]
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)] + [(None, "n", True)] * 2, "doc_id long, text string, kept boolean")
    rows = quality_rules.quality_rules(docs).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(texts[r.doc_id])
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0
    gibberish = "".join(f"{zlib.crc32(bytes([i % 251, i // 251])):08x}" + (" " if i % 6 == 5 else "") for i in range(600))
    held = spark.createDataFrame([(1, gibberish)], "doc_id long, text string")
    assert [r.kept for r in quality_rules.quality_rules(held).collect()] == [False]


def test_main_script_is_that_of_all_words(spark):
    """Every third word is Latin, which any stride of three would take for the whole."""
    cyrillic, latin = "абвгдежзиклмнопрст", "abcdefghiklmnopqrst"
    words = [(latin if i % 3 == 0 else cyrillic)[i % 17] + "".join((latin if i % 3 == 0 else cyrillic)[(i // 17**k * 5 + k) % 18] for k in range(5)) for i in range(600)]
    got = quality_rules.quality_rules(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert (got.base_failed, got.kept, got.script) == (False, True, "CYRILLIC") and got.chars_per_token < quality_rules.BANDS["LATIN"][0][0]


def slow_measures(text):
    """The three measures from the libraries' own encoders, word by word."""
    words = WORD.findall(text or "")
    ids = [i for w in words for i in quality_rules.byte_encoding(None).encode_ordinary(" " + w)]
    chars = sum(map(len, words))
    model = quality_rules.piece_model(None)
    fallen = sum(model.piece_to_id(c) == model.unk_id() for w in words for c in w)
    counts = collections.Counter(ids)
    entropy = -sum(c / len(ids) * math.log2(c / len(ids)) for c in counts.values()) / math.log2(len(ids)) if len(counts) > 1 else 0.0
    return ((chars + len(words)) / len(ids) if ids else 0.0, fallen / chars if chars else 0.0, entropy)


def test_bands_by_language_equal_brute_force(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    texts = {r.doc_id: (r.text, r.lang) for r in docs.collect()}
    label = {r.doc_id: r.quality for r in labels.collect()}
    measures = {}
    for d in sorted(rows)[::40]:
        r = rows[d]
        assert np.allclose((r.chars_per_token, r.fallback_share, r.token_entropy), slow_measures(texts[d][0]), rtol=1e-9, atol=1e-12)
    for lang in {x for _, x in texts.values()}:
        good = [rows[d] for d in rows if texts[d][1] == lang and label.get(d) == 1 and not rows[d].base_failed]
        assert len(good) >= 50
        for m in quality_rules.MEASURES:
            low, high = np.quantile([r[m] for r in good], [0.001, 0.999])
            measures[lang, m] = (low - 0.05 * (high - low), high + 0.05 * (high - low))
    for d, r in rows.items():
        fine = all(low - 1e-12 <= r[m] <= high + 1e-12 for m in quality_rules.MEASURES for low, high in [measures[texts[d][1], m]])
        assert r.kept == (fine and not r.base_failed) and r.by_language
    judged = [(label[d], r.kept) for d, r in rows.items() if d in label and not r.base_failed]
    assert sum(k for q, k in judged if q == 1) >= 0.99 * sum(q == 1 for q, _ in judged)
    assert sum(not k for q, k in judged if q == 0) >= 0.5 * sum(q == 0 for q, _ in judged)


def test_bands_come_from_all_labels(spark):
    """More labels than the 20,000 rows of the former sample, equal values among them."""
    rng = np.random.default_rng(5)
    n = 24_000
    values = np.round(rng.gamma(2.0, 2.0, (n, 3)), 3)
    rows = [(i, ("aa", "bb", None)[i % 3], False, *map(float, v)) for i, v in enumerate(values)]
    measured = spark.createDataFrame(rows, "doc_id long, lang string, base_failed boolean, chars_per_token double, fallback_share double, token_entropy double")
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    found = {r.of_lang: r.bands for r in quality_rules.bands_of(measured, labels, beyond=0.001, wider=0.05, enough=50).collect()}
    assert set(found) == {"aa", "bb", None}
    for j, lang in enumerate(("aa", "bb", None)):
        low, high = np.quantile(values[j::3], [0.001, 0.999], axis=0)
        margin = 0.05 * (high - low)
        assert np.allclose([(b.low, b.high) for b in found[lang]], np.stack([low - margin, high + margin], axis=1), rtol=1e-12, atol=1e-12)


def test_fertility_equals_whole_texts(spark):
    """Tokens counted word by word are those of the text with single spaces."""
    encoding = quality_rules.byte_encoding(None)
    memory = quality_rules.fertility_of(None, None)
    for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect():
        words = quality_rules.split_words(r.text)
        assert sum(len(memory[w]) // 4 for w in words) == len(encoding.encode_ordinary(" " + " ".join(words)))


def test_classifier_on_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r for r in quality_classifier.quality_classifier(docs, labels).collect()}
    assert len(rows) == docs.count()
    told = [(r.quality, rows[r.doc_id].selected) for r in labels.collect()]
    assert sum(s for q, s in told if q == 1) >= 0.97 * sum(q == 1 for q, _ in told)
    assert sum(not s for q, s in told if q == 0) >= 0.8 * sum(q == 0 for q, _ in told)


def test_weights_equal_brute_force(spark):
    """Counts of hashed features in dictionaries, token by token."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    name = lambda t: common.token_hashes(pa.array([t]), common.WORDS_AND_MARKS, lower=False)[0][0]
    named: dict = {}

    def features(text):
        tokens = re.findall(r"[0-9A-Za-z_\x80-\U0010ffff]+|[^\s0-9A-Za-z_\x80-\U0010ffff\x1c-\x1f]+", text)
        h = [named.setdefault(t, name(t)) for t in tokens]
        pair = lambda a, b: common.mix64(np.array([a], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b)[0]
        return [int(x % np.uint64(quality_classifier.BUCKETS)) for x in [*h, *map(pair, h[:-1], h[1:])]]

    found = {d: features(t) for d, t in texts.items()}
    raw = collections.Counter(f for some in found.values() for f in some)
    target = collections.Counter(f for d, some in found.items() if d in good for f in some)
    share = sum(target.values()) / sum(raw.values())
    rows = quality_classifier.quality_classifier(docs, labels).collect()
    for r in rows:
        want = sum(math.log((target[f] + 500) / (raw[f] * share + 500)) for f in found[r.doc_id])
        assert math.isclose(r.log_weight, want, rel_tol=1e-6, abs_tol=1e-6)
    k = sum(r.log_weight > math.log(0.05) for r in rows)
    chosen = sorted(rows, key=lambda r: (-r.key, r.doc_id))[:k]
    assert {r.doc_id for r in rows if r.selected} == {r.doc_id for r in chosen}


def test_equal_rows_at_the_cut(spark):
    rows = spark.createDataFrame([(1, 2.0)] * 3 + [(2, 1.0)] * 9000 + [(None, 1.0)] * 4 + [(3, 0.0)], "doc_id long, key double")
    for k in (2, 3, 5, 8000, 9003, 9005, 9008):
        got = collections.Counter(r.doc_id for r in quality_classifier.top_k(rows.repartition(5), k).filter("selected").collect())
        want = collections.Counter(([1] * 3 + [2] * 9000 + [None] * 4 + [3])[:k])
        assert got == want, k


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(3)
    keys = [float(x) for x in rng.normal(0, 1, 500)] + [0.5] * 40 + [1e9, -1e9]
    rows = spark.createDataFrame(list(enumerate(keys)), "doc_id long, key double")
    order = [i for _, i in sorted((-k, i) for i, k in enumerate(keys))]
    for k in (0, 1, 77, 150, 540, 541, 542, 900):
        got = {r.doc_id for r in quality_classifier.top_k(rows, k, bins=16, rounds=3).collect() if r.selected}
        assert got == set(order[:k]), k
    assert quality_classifier.top_k(rows.limit(0), 3).count() == 0


def test_classifier_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (None, "a b c", 1.0), (4, "a b", 1.0), (4, "a b", 1.0)], "doc_id long, text string, key double")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    rows = quality_classifier.quality_classifier(docs, none).collect()
    assert len(rows) == 5 and all(r.selected and r.log_weight == 0 for r in rows)
    assert quality_classifier.quality_classifier(docs.limit(0), none).count() == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows.values())
    right = [rows[r.doc_id].predicted == r.toxic for r in labels.collect() if rows[r.doc_id].held_out]
    assert sum(right) >= 0.93 * len(right)


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "x", 1), (3, "x" * 200_000, 1), (3, "y", 1), (3, "y", 1)], "doc_id long, text string, predicted int")
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 1), (3, 1)], "doc_id long, toxic int")
    assert len(toxicity.toxicity(docs, labels.limit(0)).collect()) == 6
    assert len(toxicity.toxicity(docs, labels).collect()) == 6
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_lexicon_folds_and_spares():
    lexicon = toxicity.Lexicon({"idiot": 3.0, "trash": 2.0}, ["trash can"])
    hits = lambda t: [x for _, x in lexicon.hits(toxicity.folded(t))]
    assert hits("You 1d10t! ІDІОТ, i​diots ｉｄｉｏｔ") == ["idiot"] * 4
    assert hits("the trash can, but tr@sh. trashy") == ["trash", "trash"]
    assert hits("patriot diots") == [] and hits("") == []


def test_scores_equal_a_plain_search(spark):
    """Each score from the lexicon by searching every term and phrase by itself."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").join(labels.select("doc_id", "toxic"), "doc_id")
    lexicon = toxicity.learn(known)
    assert lexicon.weights

    def slow(text):
        text = toxicity.folded(text)
        at = lambda w: [m.start() + 1 for m in re.finditer(f"(?= {re.escape(w)})", text)]
        spared = [(s, s + len(p)) for p in lexicon.exceptions for s in at(p + " ")]
        weight = sum(w for t, w in lexicon.weights.items() for s in at(t) if not any(a <= s < b for a, b in spared))
        z = lexicon.fit[0] + lexicon.fit[1] * math.log1p(weight) + lexicon.fit[2] * math.log1p(100 * weight / max(1, text.count(" ")))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))

    for r in docs.limit(60).collect():
        assert math.isclose(lexicon.score(r.text), slow(r.text), rel_tol=1e-9)


def test_a_shuffle_is_told_by_the_plan_and_not_by_a_columns_name(spark, tmp_path):
    spark.range(10).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text", "id AS Exchange").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    assert not lm_scoring.shuffled(docs.filter("Exchange > 2")) and not lm_scoring.shuffled(docs.selectExpr("doc_id", "text AS `x Exchange`"))
    assert lm_scoring.shuffled(docs.repartition(3)) and lm_scoring.shuffled(docs.groupBy("doc_id").count())
    assert lm_scoring.shuffled(docs.join(docs.hint("broadcast"), "doc_id"))
