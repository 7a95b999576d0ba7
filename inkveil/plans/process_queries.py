"""Queries over whole stages: analyse and redact, chunked services, plates in images."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import PLATES
from ..operators import detect, images, jobs, language, processor
from .base import TERM_SQL, TERMS, TOKENS, derived, query, read, sql_language, sql_words, text
from .detect_queries import _found, _plates
from .image_queries import OCR_ROWS, _ocr

RULES = [{"kind": "pattern", "name": n, "pattern": n} for n in ("email", "phone", "card", "ip")]
_all = " UNION ALL ".join(_found("documents", "doc_id", "text", r["name"]) for r in RULES)
GATE = sql_language()
WANTED = f"wanted AS (SELECT DISTINCT doc_id, replace(term, chr(10), ' ') AS term FROM ({_all}) SEMI JOIN (SELECT doc_id FROM gate WHERE is_english) USING (doc_id))"
OWN = TERMS.replace(TERM_SQL, "SELECT DISTINCT md5(term) AS term_id, term FROM wanted")
ANALYSE = f"{GATE}, {WANTED}, {TOKENS[1:]}{OWN}"


def _model(spark, sf_dir):
    return language.fit(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "text")


@query(f"""WITH {ANALYSE}, p AS (SELECT doc_id, count(*) AS n FROM boxes JOIN (SELECT doc_id, md5(term) AS term_id FROM wanted) USING (doc_id, term_id) GROUP BY doc_id)
SELECT doc_id, CASE WHEN is_english THEN 'ANALYSED' ELSE 'BLOCKED' END AS status, coalesce(t.n, 0) AS n_terms, coalesce(p.n, 0) AS n_boxes
FROM gate LEFT JOIN (SELECT doc_id, count(*) AS n FROM wanted GROUP BY doc_id) t USING (doc_id) LEFT JOIN p USING (doc_id)""")
def analyse_documents(spark, sf_dir):
    return processor.processor("text").analyse(_docs(spark, sf_dir), RULES, _model(spark, sf_dir))[1]


@query(f"""WITH {ANALYSE}, own AS (SELECT DISTINCT s.doc_id, line_no, unnest(range(first, last + 1)) AS pos FROM spans s JOIN (SELECT doc_id, md5(term) AS term_id FROM wanted) USING (doc_id, term_id)),
n AS (SELECT doc_id, count(*) AS n FROM own GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_redactions, CASE WHEN coalesce(n, 0) > 0 THEN 'SUCCESS' ELSE 'FAIL' END AS status FROM documents LEFT JOIN n USING (doc_id)""")
def process_documents(spark, sf_dir):
    """Analysed, all proposals accepted, and redacted."""
    text_files = processor.processor("text")
    proposed, _ = text_files.analyse(_docs(spark, sf_dir), RULES, _model(spark, sf_dir))
    return text_files.redact(_docs(spark, sf_dir), proposed)[1]


def _ask(chunk: str):
    """A stand-in for a service: words with an @ of a chunk; tokens are its words and its terms."""
    words = [w for w in chunk.split(" ") if w]
    terms = [w.strip(".,;:()") for w in words if "@" in w]
    return terms, len(words), len(terms)


@query("SELECT DISTINCT doc_id, 'service' AS rule_name, t AS term FROM (SELECT doc_id, unnest(list_transform(list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda w: contains(w, '@')), lambda w: trim(w, '.,;:()'))) AS t FROM documents)")
def detect_by_chunks(spark, sf_dir):
    """Chunks end at spaces here, so that each word is in one whole."""
    rows, _ = detect.chunked_service(_docs(spark, sf_dir), {"name": "service", "call": lambda c: _ask(c.replace("\n", " "))})
    return rows.select("doc_id", "rule_name", "term")


_asked = "lambda w: trim(w, '.,;:()')"
NAMED = f"SELECT DISTINCT t AS term FROM (SELECT unnest(list_transform(list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda w: contains(w, '@')), {_asked})) AS t FROM documents)"


@query(f"""WITH w AS (SELECT image_id, "at", {sql_words('text')}[1] AS word, x0, y0 FROM ({OCR_ROWS})),
p AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY "at") - 1 AS gpos FROM w WHERE word IS NOT NULL),
m AS (SELECT doc_id AS image_id, term FROM documents, ({NAMED}) WHERE contains(replace(text, chr(10), ' '), term)),
t AS (SELECT image_id, term, len(ws) AS n, unnest(range(len(ws))) AS off, unnest(ws) AS word FROM (SELECT image_id, term, {sql_words('term')} AS ws FROM m)),
s AS (SELECT image_id, term, gpos - off AS start, any_value(n) AS n FROM p JOIN t USING (image_id, word) GROUP BY image_id, term, gpos - off HAVING count(*) = any_value(n))
SELECT DISTINCT image_id, term AS name, x0, y0 FROM s JOIN p USING (image_id) WHERE gpos BETWEEN start AND start + n - 1""")
def image_text_rule(spark, sf_dir):
    """Texts of images to a service by distinct chunks, what it names back to all images that have it, and to boxes."""
    docs = read(spark, sf_dir, "documents")
    said = docs.select(F.col("doc_id").alias("image_id"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))  # `_ocr`'s words, with spaces
    shown = docs.select(F.col("doc_id").alias("image_id"), F.lit(100).alias("width"), F.lit(100).alias("height"), F.lit(None).cast("string").alias("error"))
    boxes, _ = images.image_text(shown, lambda some: images.ocr_packed(_ocr(spark, sf_dir, some), kind="double"), {"name": "service", "call": _ask}, texts=said)
    return boxes.select("image_id", "name", F.col("box.x0").cast("int").alias("x0"), F.col("box.y0").cast("int").alias("y0"))


_spared = " AND ".join(f"NOT ends_with(lower(term), '{e}')" for e in detect.PUBLIC_ENDS)
_default = " UNION ALL ".join(
    f"SELECT '{r['name']}' AS rule_name, doc_id FROM ({_found('documents', 'doc_id', 'text', r['pattern'])})" + (f" WHERE {_spared}" if "spare" in r else "") for r in processor.DEFAULT_RULES if r["kind"] == "pattern"
)


@query(f"SELECT rule_name, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM ({_default} UNION ALL SELECT 'plates', doc_id FROM (SELECT doc_id, unnest({_plates.replace('(s,', '(text,')}) AS f FROM documents)) GROUP BY rule_name")
def default_rules(spark, sf_dir):
    """What the rules by default propose."""
    found = detect.detect(_docs(spark, sf_dir), list(processor.DEFAULT_RULES))
    return found.groupBy("rule_name").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


#: Words that text detection saw in images, from events: registrations over one or two words, in either reading, and none.
OCR_WORDS = """SELECT event_id AS image_id, p AS at, CASE event_id % 4 WHEN 0 THEN CASE p WHEN 0 THEN 'car' WHEN 1 THEN 'AB' || (10 + user_id % 90) WHEN 2 THEN 'CDE' ELSE 'parked' END
 WHEN 1 THEN CASE p WHEN 0 THEN 'A8O' || (user_id % 10) WHEN 1 THEN 'XYZ' WHEN 2 THEN '--' ELSE 'by' END WHEN 2 THEN 'nothing' ELSE CASE p WHEN 0 THEN 'ABI' || (user_id % 10) WHEN 1 THEN 'CDE,' WHEN 2 THEN 'or' ELSE 'K' || (user_id % 1000) || ' ABC' END END AS text
 FROM (SELECT event_id, user_id, explode(array(0, 1, 2, 3)) AS p FROM events WHERE event_id % 9 > 0)"""
OCR_IMAGES = "SELECT event_id AS image_id, CAST(100 AS DOUBLE) AS width, CAST(50 AS DOUBLE) AS height, CASE WHEN event_id % 9 = 0 THEN 'timeout' END AS error FROM events"


def _plate_hits(a: str, b: str) -> str:
    """CTEs of one reading: the registrations of each image's text, and the words in a row that each covers."""
    said = f"translate(text, '{a}', '{b}')"
    return f"""SELECT s.image_id, s.term AS name, p.at::DOUBLE AS x0 FROM (
  SELECT image_id, term, gpos - off AS start, any_value(n) AS n FROM (SELECT image_id, term, len(ws) AS n, unnest(range(len(ws))) AS off, unnest(ws) AS word FROM (SELECT image_id, term, {sql_words('term')} AS ws FROM (
      SELECT image_id, unnest(list_distinct(regexp_extract_all(string_agg({said}, ' ' ORDER BY at), {text('(' + PLATES + ')')}))) AS term FROM words GROUP BY image_id))) t
    JOIN (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY at) - 1 AS gpos FROM (SELECT image_id, at, {sql_words(said)}[1] AS word FROM words) WHERE word IS NOT NULL) w USING (image_id, word)
    GROUP BY image_id, term, gpos - off HAVING count(*) = any_value(n)) s
  JOIN (SELECT image_id, at, row_number() OVER (PARTITION BY image_id ORDER BY at) - 1 AS gpos FROM words WHERE len({sql_words(said)}) > 0) p ON p.image_id = s.image_id AND p.gpos BETWEEN s.start AND s.start + s.n - 1"""


_words = OCR_WORDS.replace("explode(array(0, 1, 2, 3))", "unnest([0, 1, 2, 3])").replace(" AS at,", ' AS "at",')


@query(f"""WITH words AS ({_words}) SELECT DISTINCT image_id, name, x0 FROM ({_plate_hits('01', 'OI')} UNION ALL {_plate_hits('OI', '01')} UNION ALL SELECT image_id, 'Text Detection Failed', 0 FROM ({OCR_IMAGES}) WHERE error IS NOT NULL)""".replace("ORDER BY at", 'ORDER BY "at"').replace("p.at::", 'p."at"::').replace("image_id, at,", 'image_id, "at",'))
def plate_boxes(spark, sf_dir):
    box = F.struct(F.col("at").cast("double").alias("x0"), F.lit(0.0).alias("y0"), (F.col("at") + 1).cast("double").alias("x1"), F.lit(1.0).alias("y1"))
    words = derived(spark, sf_dir, OCR_WORDS).withColumn("box", box)
    return images.plate_boxes(derived(spark, sf_dir, OCR_IMAGES), words).select("image_id", "name", F.col("box.x0").alias("x0"))


@query("SELECT CAST(event_id AS VARCHAR) AS id, 'ANALYSE' AS stage, ts + INTERVAL 1 DAY AS expires FROM events")
def queue_messages(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("ts", F.to_json(F.struct(F.col("event_id").cast("string").alias("overrideId"), F.col("event_type").alias("fileKind"))).alias("body"))
    out = jobs.queue_messages(e, F.lit("ANALYSE"))
    return out.select("id", F.get_json_object("value", "$.stage").alias("stage"), F.col("expires").cast("timestamp_ntz").alias("expires"))


@query("SELECT event_id AS image_id, CASE WHEN event_id % 7 = 0 THEN 'Face Detection Failed' ELSE 'Face Detected' END AS name, CASE WHEN event_id % 7 = 0 THEN 640.0 ELSE 20.0 END::DOUBLE AS x1 FROM events WHERE event_id % 7 = 0 OR event_id % 2 = 0")
def detector_failures(spark, sf_dir):
    """A detector that fails for some images and finds nothing in others."""
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("image_id"))
    asked = e.select("image_id", F.lit(640).alias("width"), F.lit(480).alias("height"))
    box = F.struct(F.lit(10.0).alias("x0"), F.lit(10.0).alias("y0"), F.lit(20.0).alias("x1"), F.lit(20.0).alias("y1"))
    results = e.select("image_id", F.when((F.col("image_id") % 2 == 0) & (F.col("image_id") % 7 != 0), box).alias("box"), F.when(F.col("image_id") % 7 == 0, "busy").alias("error"))
    return images.detected(asked, results, "Face").select("image_id", "name", F.col("box.x1").alias("x1"))
