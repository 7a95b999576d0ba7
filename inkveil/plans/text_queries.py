"""Queries on text, layout and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import collapsed, normalised, normalised_words, page_clean
from ..operators import layout, matching
from .base import LINES, TERM_SQL, TERMS, TOKENS, chars, derived, query, read, sql_clean, sql_normal, sql_words, terms_of


@query(f"SELECT doc_id, len({sql_words('text')}) AS n_words, md5(array_to_string({sql_words('text')}, ' ')) AS words_md5, md5({sql_normal('text')}) AS text_md5 FROM documents")
def normalised_text(spark, sf_dir):
    words = normalised_words(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("n_words"), F.md5(F.array_join(words, " ")).alias("words_md5"), F.md5(normalised(F.col("text"))).alias("text_md5"))


#: Lines of documents among marks, accents and white space of several kinds.
FORMS = "SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN '   ' || text || ' !' WHEN 1 THEN '“' || text || '” …' WHEN 2 THEN '«¿' || text || '?»' WHEN 3 THEN text || ' — Bob’s' ELSE text END AS s FROM documents"


@query(f"SELECT id, md5(array_to_string({sql_words('s')}, '|')) AS words_md5, md5({sql_normal('s')}) AS plain_md5, md5(trim(regexp_replace(s, '\\s+', ' ', 'g'))) AS collapsed_md5 FROM ({FORMS})")
def normal_forms(spark, sf_dir):
    s = F.col("s")
    return derived(spark, sf_dir, FORMS).select("id", F.md5(F.array_join(normalised_words(s), "|")).alias("words_md5"), F.md5(normalised(s)).alias("plain_md5"), F.md5(collapsed(s)).alias("collapsed_md5"))


@query(f"SELECT doc_id, length(nullif({sql_clean('text')}, '')) AS n, md5(nullif({sql_clean('text')}, '')) AS text_md5 FROM documents")
def page_text(spark, sf_dir):
    c = page_clean(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.length(c).cast("long").alias("n"), F.md5(c).alias("text_md5"))


@query(f"WITH {LINES[1:]} SELECT doc_id, page_no, line_no, len(words) AS n_words, md5(array_to_string(words, ' ')) AS words_md5, y0, y1 FROM boxed")
def page_lines(spark, sf_dir):
    return layout.lines(read(spark, sf_dir, "documents")).select("doc_id", "page_no", "line_no", F.size("words").cast("long").alias("n_words"), F.md5(F.array_join("words", " ")).alias("words_md5"), "y0", "y1")


@query(f"WITH {LINES[1:]} SELECT doc_id, page_no, count(*) AS n_lines, min(y0) AS top, max(y1) AS bottom, max(length(array_to_string(words, ' ')))::DOUBLE AS width FROM boxed GROUP BY doc_id, page_no")
def page_boxes(spark, sf_dir):
    rows = layout.lines(read(spark, sf_dir, "documents"))
    return rows.groupBy("doc_id", "page_no").agg(F.count("*").alias("n_lines"), F.min("y0").alias("top"), F.max("y1").alias("bottom"), F.max(layout.word_end(F.col("words"), F.size("words") - 1)).alias("width"))


@query(f"WITH {TOKENS[1:]} SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_docs, min(gpos) AS first_at FROM tokens GROUP BY word")
def word_index(spark, sf_dir):
    return matching.word_index(read(spark, sf_dir, "documents"))


PAGES = f"""pages AS (
  SELECT doc_id, CAST(unnest(range(n)) AS INT) AS page_no, unnest(ps) AS raw_text FROM (
    SELECT doc_id, n, list_transform(range(n), lambda p: {sql_clean("array_to_string(list_slice(ls, p * 10 + 1, p * 10 + 10), chr(10))")}) AS ps
    FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, greatest(1, CAST(ceil(len(string_split(text, chr(10))) / 10.0) AS BIGINT)) AS n FROM documents))),
ahead AS (SELECT *, lead(raw_text) OVER (PARTITION BY doc_id ORDER BY page_no) AS next_text FROM pages)"""


@query(f"WITH {PAGES} SELECT doc_id, page_no, md5(raw_text) AS page_md5, md5(next_text) AS next_md5 FROM ahead")
def page_look_ahead(spark, sf_dir):
    pages = layout.with_next_page(layout.page_texts(read(spark, sf_dir, "documents")))
    return pages.select("doc_id", "page_no", F.md5("raw_text").alias("page_md5"), F.md5("next_text").alias("next_md5"))


@query(f"WITH {LINES[1:]} SELECT doc_id, line_no, md5(array_to_string(lead(words) OVER (PARTITION BY doc_id ORDER BY line_no), ' ')) AS next_md5, lead(page_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS next_page FROM boxed")
def line_continuation(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("line_no")
    return layout.lines(read(spark, sf_dir, "documents")).select("doc_id", "line_no", F.md5(F.array_join(F.lead("words").over(w), " ")).alias("next_md5"), F.lead("page_no").over(w).alias("next_page"))


_raw_lines = "SELECT doc_id, CAST(unnest(range(len(ls))) AS INT) AS no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)"
RAW_WORDS = f"""SELECT doc_id AS page_id, no * 100000 + k AS seq, no // 7 AS block_no, no % 7 AS line_no, w AS word, (10 * k)::DOUBLE AS x0, (20 * no + k % 3)::DOUBLE AS y0, (20 * no + 10 + k % 2)::DOUBLE AS y1
FROM (SELECT doc_id, no, CAST(unnest(range(len(ws))) AS INT) AS k, unnest(ws) AS w FROM (SELECT doc_id, no, string_split(line, ' ') AS ws FROM ({_raw_lines})))"""


def _raw_words(spark, sf_dir):
    """Words as a reader of pages gives them: marks and capitals kept, block and line by number."""
    lines = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    words = lines.select("page_id", "no", F.posexplode(F.split("line", " ")).alias("k", "word"))
    no, k = F.col("no"), F.col("k")
    return words.select("page_id", (no * 100000 + k).alias("seq"), F.floor(no / 7).alias("block_no"), (no % 7).alias("line_no"), "word", (10.0 * k).alias("x0"), (20.0 * no + k % 3).alias("y0"), (10.0 * k + 9).alias("x1"), (20.0 * no + 10 + k % 2).alias("y1"))


@query(f"""WITH raw AS ({RAW_WORDS}),
flagged AS (SELECT *, CASE WHEN lag(block_no) OVER w <> block_no OR lag(line_no) OVER w <> line_no THEN 1 ELSE 0 END AS changed FROM raw WINDOW w AS (PARTITION BY page_id ORDER BY seq)),
runs AS (SELECT *, sum(changed) OVER (PARTITION BY page_id ORDER BY seq) AS run, array_to_string({sql_words('word')}, ' ') AS plain FROM flagged),
grouped AS (SELECT page_id, run, string_agg(plain, ' ' ORDER BY seq) AS words, string_agg(x0::INT::VARCHAR, ' ' ORDER BY seq) AS x0, min(y0) AS y0, max(y1) AS y1 FROM runs WHERE plain <> '' GROUP BY page_id, run)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY run) - 1 AS line_number, md5(words) AS words_md5, md5(x0) AS x0_md5, y0, y1 FROM grouped""")
def line_segmentation(spark, sf_dir):
    out = layout.segment_lines(_raw_words(spark, sf_dir))
    starts = F.array_join(F.transform("x0", lambda x: x.cast("int").cast("string")), " ")
    return out.select("page_id", F.col("line_number").cast("long").alias("line_number"), F.md5(F.array_join("words", " ")).alias("words_md5"), F.md5(starts).alias("x0_md5"), "y0", "y1")


FLAT = "replace(replace({}, chr(10), ' '), '  ', ' ')"
_both = "concat_ws(chr(10), raw_text, next_text)"
PREFILTER = f"""held AS (SELECT doc_id, page_no, {FLAT.format(_both)} AS flat, {FLAT.format(f"replace({_both}, '-' || chr(10), '-')")} AS kept, {FLAT.format(f"replace({_both}, '-' || chr(10), '')")} AS joined FROM ahead),
wanted AS (SELECT term_id, trim(regexp_replace(term, '\\s+', ' ', 'g')) AS term FROM ({TERM_SQL}))
SELECT doc_id, page_no, term_id FROM held, wanted WHERE contains(flat, term) OR contains(kept, term) OR contains(joined, term)"""


@query(f"WITH {PAGES}, {PREFILTER}")
def term_prefilter(spark, sf_dir):
    pages = layout.with_next_page(layout.page_texts(read(spark, sf_dir, "documents")))
    return matching.prefilter(pages, terms_of(spark, sf_dir))


@query(f"WITH {TOKENS[1:]}{TERMS} SELECT doc_id, term_id, start, n FROM starts")
def match_phrase(spark, sf_dir):
    return matching.phrase_starts(read(spark, sf_dir, "documents"), terms_of(spark, sf_dir)).select("doc_id", "term_id", "start", F.col("n").cast("long").alias("n"))


@query(f"WITH {TOKENS[1:]}{TERMS} SELECT doc_id, term_id, line_no, pos, word FROM singles")
def match_single(spark, sf_dir):
    return matching.single_matches(read(spark, sf_dir, "documents"), terms_of(spark, sf_dir))


@query(f"WITH {TOKENS[1:]}{TERMS} SELECT doc_id, term_id, start, page_no, line_no, x0, y0, x1, y1 FROM boxes")
def redaction_rects(spark, sf_dir):
    return matching.rects(read(spark, sf_dir, "documents"), terms_of(spark, sf_dir))


@query(f"WITH {TOKENS[1:]}{TERMS} SELECT doc_id, term_id, start, page_no, line_no, 'Text Redaction' AS title, x0 AS \"left\", y0 AS top, x1 AS \"right\", y1 AS bottom FROM boxes")
def highlight_boxes(spark, sf_dir):
    return matching.highlights(matching.rects(read(spark, sf_dir, "documents"), terms_of(spark, sf_dir)))


@query(f"WITH {TOKENS[1:]}{TERMS} SELECT term_id, count(b.doc_id) AS hits FROM terms LEFT JOIN boxes b USING (term_id) GROUP BY term_id")
def term_hits(spark, sf_dir):
    terms = terms_of(spark, sf_dir)
    return matching.term_hits(terms, matching.box_counts(read(spark, sf_dir, "documents"), terms))


@query(f"WITH {TOKENS[1:]}{TERMS} SELECT term_id, term FROM terms WHERE term_id NOT IN (SELECT term_id FROM boxes)")
def unapplied_terms(spark, sf_dir):
    terms = terms_of(spark, sf_dir)
    return matching.unapplied(terms, matching.box_counts(read(spark, sf_dir, "documents"), terms))


@query(f"""WITH {TOKENS[1:]}{TERMS}, proposals AS (SELECT 'rule' || (term_id % 4) AS rule_name, term, term_id FROM terms),
applied AS (SELECT DISTINCT term FROM terms WHERE term_id IN (SELECT term_id FROM boxes))
SELECT rule_name, count(*) AS n_proposed, count(a.term) AS n_applied FROM proposals p LEFT JOIN applied a USING (term) GROUP BY rule_name""")
def rule_summary(spark, sf_dir):
    terms = terms_of(spark, sf_dir)
    boxes = matching.box_counts(read(spark, sf_dir, "documents"), terms)
    proposals = terms.select(F.concat(F.lit("rule"), (F.col("term_id") % 4).cast("string")).alias("rule_name"), "term")
    return matching.rule_summary(proposals, terms.join(boxes.select("term_id"), "term_id", "left_semi"))


PROPOSED = "SELECT event_type AS rule_name, CASE WHEN event_id % 2 = 0 THEN 'user' || chr(10) || user_id ELSE 'user ' || user_id END AS term FROM events WHERE event_id % 3 > 0"
RULES = "SELECT event_type AS rule_name, CAST(min(event_id) AS INT) AS ordinal, CASE WHEN min(event_id) % 2 = 0 THEN upper(event_type) END AS label FROM events GROUP BY event_type"


@query(f"SELECT term, min_by(coalesce(label, rule_name), ordinal) AS label FROM (SELECT rule_name, replace(term, chr(10), ' ') AS term FROM ({PROPOSED})) JOIN ({RULES}) USING (rule_name) GROUP BY term")
def term_label(spark, sf_dir):
    return matching.term_labels(derived(spark, sf_dir, PROPOSED), derived(spark, sf_dir, RULES))


#: Lines, terms and whether the line has the term.
TRUTH = [
    ("the", "he", False), ("Bob’s", "Bob", True), ("bobs house", "bob", False), ("François", "Francois", False), ("somethingMonica Cowan", "Monica Cowan", True),
    ("Monica Cowansomething", "Monica Cowan", True), ("johnsmith", "smith", False), ("byof cowan", "of cowan", False), ("John Smiths home", "John Smith", True),
    ("alpha betaX gamma", "alpha beta gamma", False), ("alpha beta gamma", "alpha beta gamma", True), ("alpha beta", "alpha beta gamma", False), ("(John) Smith,", "john smith", True), ("", "a", False),
]


#: Lines, terms and whether the line ends with the beginning of the term up to a hyphen.
HYPHENS = [("seen by Mary Hugh", "Mary Hugh-Williams", True), ("Hugh", "Hugh-Williams", True), ("by Hugh", "Mary Hugh-Williams", False), ("the two-part", "two-part-name", True), ("part", "two-part-name", True), ("name", "two-part-name", False), ("Mary", "Mary Hugh-Williams", False)]


def _among(rows) -> str:
    """Each stated case with the words of a document's first line ahead of it."""
    values = ", ".join(f"({i}, {chars(a) if a else repr('')}, {chars(b)}, {str(e).lower()})" for i, (a, b, e) in enumerate(rows))
    return f"""SELECT doc_id, id, md5(lead || line) AS line_md5, term, expected OR (len(string_split(term, ' ')) = 1 AND list_contains({sql_words('lead')}, lower(term))) AS matched
FROM (SELECT doc_id, coalesce(regexp_replace(string_split(text, chr(10))[1], '[^A-Za-z ]', 'x', 'g'), '') || ' zz ' AS lead FROM documents), (VALUES {values}) t(id, line, term, expected)"""


def _cases(spark, sf_dir, rows):
    cases = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(a).alias("line"), F.lit(b).alias("term")) for i, (a, b, _) in enumerate(rows)])
    lead = F.concat(F.coalesce(F.regexp_replace(F.split("text", "\n")[0], "[^A-Za-z ]", "x"), F.lit("")), F.lit(" zz "))
    held = read(spark, sf_dir, "documents").select("doc_id", lead.alias("lead"), F.explode(cases).alias("c"))
    return held.select("doc_id", "c.id", F.concat("lead", "c.line").alias("line"), "c.term")


@query(_among(TRUTH))
def match_truth_table(spark, sf_dir):
    """The stated cases at the end of a line of each document."""
    return _cases(spark, sf_dir, TRUTH).select("doc_id", "id", F.md5("line").alias("line_md5"), "term", matching.in_line(normalised_words(F.col("line")), normalised_words(F.col("term"))).alias("matched"))


@query(_among([h for h in HYPHENS if h[2]]))
def match_hyphen(spark, sf_dir):
    """The stated cases that hold, whatever stands before them on the line."""
    rows = _cases(spark, sf_dir, [h for h in HYPHENS if h[2]])
    return rows.select("doc_id", "id", F.md5("line").alias("line_md5"), "term", matching.hyphen_tail(normalised_words(F.col("line")), normalised_words(F.col("term"))).alias("matched"))


@query(f"WITH {TOKENS[1:]} SELECT doc_id, line_no // 20 AS sheet, CAST(row_number() OVER (PARTITION BY doc_id, line_no // 20 ORDER BY gpos) - 1 AS INT) AS seq, CAST(line_no % 20 // 10 AS INT) AS column_no, word FROM tokens")
def reading_order(spark, sf_dir):
    """Pages laid side by side on sheets, two columns each, words uneven in height and in no order:
    the order comes back from the boxes alone."""
    # all places are worked out in the document's row, so that words are moved by the operator alone
    lines = layout.lines(read(spark, sf_dir, "documents"))
    placed = lines.withColumn("ahead", layout.word_starts(F.col("words"))).select("doc_id", "line_no", F.posexplode(F.arrays_zip("ahead", F.col("words").alias("word"))).alias("pos", "w"))
    words = placed.select("doc_id", "line_no", "pos", "w.ahead", F.col("w.word").alias("word"))
    # lines have no gaps, so that each sheet has words in its first column
    sheet, side = F.floor(F.col("line_no") / 20), F.floor(F.col("line_no") % 20 / 10)
    x0 = F.col("ahead") + side * 10_000_000  # wider than any line
    y0 = layout.line_top(F.col("line_no")) + F.col("pos") % 3
    boxes = words.select(F.struct("doc_id", sheet.alias("sheet")).alias("page"), x0.cast("double").alias("x0"), y0.alias("y0"), (x0 + F.length("word")).cast("double").alias("x1"), (y0 + layout.LINE_HEIGHT).alias("y1"), "word")
    read_ = layout.reading_order(boxes, "page")
    return read_.select("page.doc_id", "page.sheet", "seq", "column_no", "word")
