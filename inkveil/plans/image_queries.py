"""Queries on images, annotations and rules."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import raster
from ..functions.text import normalised_words, xml_section
from ..operators import images, rules
from ..operators.matching import ocr_matches
from .base import TERM_SQL, derived, query, read, sql_words, terms_of, text

SIZES = "SELECT event_id AS id, CAST(event_id * 9973 % 42000000 AS BIGINT) AS n, CAST(event_id % 120 AS INT) AS w, CAST(event_id * 31 % 17000 AS INT) AS h FROM events"


@query(f"SELECT id, n <= 20971520 AND w BETWEEN 50 AND 16000 AND h BETWEEN 50 AND 16000 AS fits FROM ({SIZES})")
def image_size_gate(spark, sf_dir):
    return derived(spark, sf_dir, SIZES).select("id", images.size_gate(F.col("n"), F.col("w"), F.col("h")).alias("fits"))


@query("SELECT event_id, CASE WHEN value >= 50 THEN event_type END AS label, round(value, 4) AS score FROM events WHERE value >= 10")
def confidence_filter(spark, sf_dir):
    return read(spark, sf_dir, "events").filter("value >= 10").select("event_id", F.when(F.col("value") >= 50, F.col("event_type")).alias("label"), F.round("value", 4).alias("score"))


#: Placements of images on pages, from events: scaled, turned, mirrored and skewed.
AFFINE = "SELECT event_id AS id, " + ", ".join(f"CAST(event_id * {k} % {m} - {m // 2} AS DOUBLE) AS {c}" for c, k, m in zip("abcdef", (7, 11, 13, 17, 19, 23), (201, 31, 41, 203, 600, 800), strict=True)) + " FROM events"
_corner = lambda fun, m: f"{fun}({', '.join(f'{m[0]} * {x} / 100 + {m[1]} * {y} / 100 + {m[2]}' for x in (0, 100) for y in (50, 60))})"


@query(f"SELECT id, round({_corner('least', 'ace')}, 6)::DOUBLE AS x0, round({_corner('least', 'bdf')}, 6)::DOUBLE AS y0, round({_corner('greatest', 'ace')}, 6)::DOUBLE AS x1, round({_corner('greatest', 'bdf')}, 6)::DOUBLE AS y1 FROM ({AFFINE})")
def bbox_to_page(spark, sf_dir):
    rows = derived(spark, sf_dir, AFFINE)
    lit = lambda v: F.lit(float(v))
    box = images.affine_box(lit(0), lit(50), lit(100), lit(60), lit(100), lit(100), F.array(*[F.col(k) for k in "abcdef"]))
    return rows.select("id", box.alias("q")).select("id", *[F.round(F.col(f"q.{k}"), 6).alias(k) for k in ("x0", "y0", "x1", "y1")])


BOXES = "SELECT event_id AS id, CAST(event_id % 400 AS DOUBLE) / 2 AS x, CAST(event_id * 7 % 90 AS DOUBLE) / 4 - 10 AS y, CAST(user_id % 50 AS DOUBLE) / 2 AS w, CAST(user_id % 9 AS DOUBLE) AS h FROM events"


@query(f"SELECT id, CAST(round_even(x, 0) AS BIGINT) AS x0, CAST(round_even(y, 0) AS BIGINT) AS y0, CAST(round_even(x + w, 0) AS BIGINT) AS x1, CAST(round_even(y + h, 0) AS BIGINT) AS y1 FROM ({BOXES})")
def corner_boxes(spark, sf_dir):
    box = images.rounded(images.corners(F.col("x"), F.col("y"), F.col("w"), F.col("h")))
    return derived(spark, sf_dir, BOXES).select("id", box.alias("q")).select("id", "q.*")


def _ocr(spark, sf_dir, only=None):
    """Documents as what text detection gives for images: a block a text, its lines, their words in polygons;
    with `only` (image_id) for these images alone."""
    docs = read(spark, sf_dir, "documents")
    docs = docs if only is None else docs.join(only, F.col("doc_id") == F.col("image_id"), "left_semi")
    point = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    words = lambda line, y: F.transform(F.split(line, " "), lambda w, i: F.struct(w.alias("text"), F.array(point(i * 10, y * 20), point(i * 10 + F.length(w), y * 20), point(i * 10 + F.length(w), y * 20 + 10), point(i * 10, y * 20 + 10)).alias("polygon")))
    lines = F.transform(F.split("text", "\n"), lambda line, y: F.struct(words(line, y).alias("words")))
    return docs.select(F.col("doc_id").alias("image_id"), F.array(F.struct(lines.alias("lines"))).alias("blocks"))


OCR_ROWS = """SELECT image_id, CAST(unnest(range(len(ws))) AS INT) AS "at", unnest(ws, recursive := true) FROM (SELECT doc_id AS image_id, flatten(list_transform(string_split(text, chr(10)), lambda l, y: list_transform(string_split(l, ' '),
  lambda w, i: {'text': w, 'x0': ((i - 1) * 10)::INT, 'y0': ((y - 1) * 20)::INT, 'x1': ((i - 1) * 10 + length(w))::INT, 'y1': ((y - 1) * 20 + 10)::INT}))) AS ws FROM documents)"""


@query(OCR_ROWS)
def ocr_flatten(spark, sf_dir):
    return images.ocr_words(_ocr(spark, sf_dir))


#: Of each image two terms of its own: two words of its text that stand together, and three that need not.
OCR_TERMS = f"""SELECT image_id, 2 * image_id AS term_id, ws[2] || ' ' || ws[3] AS term FROM (SELECT doc_id AS image_id, {sql_words("replace(text, chr(10), ' ')")} AS ws FROM documents) WHERE len(ws) > 3
UNION ALL SELECT image_id, 2 * image_id + 1, ws[1] || ' ' || ws[3] || ' ' || ws[4] FROM (SELECT doc_id AS image_id, {sql_words("replace(text, chr(10), ' ')")} AS ws FROM documents) WHERE len(ws) > 3"""


@query(f"""WITH w AS (SELECT image_id, "at", {sql_words('text')}[1] AS word, x0 FROM ({OCR_ROWS})),
p AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY "at") - 1 AS gpos FROM w WHERE word IS NOT NULL),
t AS (SELECT image_id, term_id, len(ws) AS n, unnest(range(len(ws))) AS off, unnest(ws) AS word FROM (SELECT image_id, term_id, {sql_words('term')} AS ws FROM ({OCR_TERMS}))),
s AS (SELECT image_id, term_id, gpos - off AS start, any_value(n) AS n FROM p JOIN t USING (image_id, word) GROUP BY image_id, term_id, gpos - off HAVING count(*) = any_value(n))
SELECT image_id, term_id, "at", x0 FROM s JOIN p USING (image_id) WHERE gpos BETWEEN start AND start + n - 1""")
def ocr_box_match(spark, sf_dir):
    words = images.ocr_packed(_ocr(spark, sf_dir))
    own = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), normalised_words(F.replace("text", F.lit("\n"), F.lit(" "))).alias("ws")).filter("size(ws) > 3")
    terms = own.select("image_id", F.posexplode(F.array(F.concat_ws(" ", F.col("ws")[1], F.col("ws")[2]), F.concat_ws(" ", F.col("ws")[0], F.col("ws")[2], F.col("ws")[3]))).alias("nth", "term"))
    terms = terms.select("image_id", (2 * F.col("image_id") + F.col("nth")).alias("term_id"), "term")
    return ocr_matches(words, terms).select("image_id", "term_id", "at", F.col("box.x0").alias("x0"))


@query(f"SELECT doc_id AS image_id, term FROM documents, (SELECT DISTINCT term FROM ({TERM_SQL})) WHERE contains(text, term)")
def image_strings(spark, sf_dir):
    terms = terms_of(spark, sf_dir).select("term").distinct()
    return images.strings_by_image(terms, read(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), "text"))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, min_by(source, doc_id) AS source FROM documents GROUP BY text")
def unique_content(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return images.first_of_equal(docs, F.col("text").cast("binary"), "doc_id").select("content_hash", "doc_id", "source")


@query("""WITH i AS (SELECT doc_id, CAST(doc_id % 4 AS INT) AS page_no, sha256(source) AS content_hash, (doc_id % 10)::DOUBLE AS shift FROM documents),
b AS (SELECT DISTINCT sha256(source) AS content_hash, 'face' AS name, 10.0 AS x0, 30.0 AS x1 FROM documents UNION ALL SELECT DISTINCT sha256(source), 'signature', 20.0, 80.0 FROM documents WHERE source < 'src5')
SELECT doc_id, page_no, name, (200 * x0 / 100 + shift)::DOUBLE AS x0, (200 * x1 / 100 + shift)::DOUBLE AS x1 FROM b JOIN i USING (content_hash)""")
def image_box_instances(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumn("content_hash", F.sha2("source", 256))
    m = F.array(*[F.lit(v) for v in (200.0, 0.0, 0.0, 200.0)], (F.col("doc_id") % 10).cast("double"), F.lit(0.0))
    shown = docs.select("doc_id", (F.col("doc_id") % 4).cast("int").alias("page_no"), "content_hash", F.lit(100.0).alias("width"), F.lit(100.0).alias("height"), m.alias("m"))
    box = lambda a, b: F.struct(F.lit(a).alias("x0"), F.lit(0.0).alias("y0"), F.lit(b).alias("x1"), F.lit(5.0).alias("y1"))
    found = docs.select("content_hash", "source").distinct().select("content_hash", F.when(F.col("source") < "src5", F.array(box(10.0, 30.0), box(20.0, 80.0))).otherwise(F.array(box(10.0, 30.0))).alias("boxes"), F.when(F.col("source") < "src5", F.array(F.lit("face"), F.lit("signature"))).otherwise(F.array(F.lit("face"))).alias("names"))
    return images.place_boxes(found, shown).select("doc_id", "page_no", "name", F.col("box.x0").alias("x0"), F.col("box.x1").alias("x1"))


FACES = "SELECT user_id AS image_id, 'Face' AS name, CAST(event_id % 5 AS INT) AS box FROM events WHERE event_type = 'view'"
MARKS = "SELECT user_id AS image_id, 'Signature' AS name, CAST(event_id % 3 AS INT) AS box FROM events WHERE event_type = 'click'"


@query(f"SELECT image_id, string_agg(name || box, ',' ORDER BY name, box) AS pairs FROM (SELECT * FROM ({FACES}) UNION SELECT * FROM ({MARKS})) GROUP BY image_id")
def boxes_by_image(spark, sf_dir):
    both = images.boxes_by_image(derived(spark, sf_dir, FACES), derived(spark, sf_dir, MARKS))
    return both.select("image_id", F.array_join(F.zip_with("names", "boxes", lambda n, b: F.concat(n, b.cast("string"))), ",").alias("pairs"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, (event_id % 50)::DOUBLE AS x FROM events),
marks AS (SELECT *, 8 AS kind, event_type AS content, x + 1 AS x0, x + 9 AS y1, user_id % 2 = 0 AS is_candidate FROM e WHERE event_id % 3 > 0
  UNION ALL SELECT *, 4, NULL, x + 3, x + 4, false FROM e WHERE event_id % 3 = 2)
SELECT user_id AS doc_id, e.event_id AS page_no, kind, content AS text, x0, y1, coalesce(is_candidate, false) AS is_candidate FROM e LEFT JOIN marks USING (event_id, user_id)""")
def annotation_rects(spark, sf_dir):
    """Pages from events: without annotations, with a highlight, and with a square beside it."""
    x, point = (F.col("event_id") % 50).cast("double"), lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    box = lambda a, b, c, d: F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"))
    colour = F.when(F.col("user_id") % 2 == 0, F.array(*[F.lit(c) for c in images.HIGHLIGHT]))
    mark = F.struct(F.lit(8).alias("kind"), F.lit("t").alias("title"), F.col("event_type").alias("content"), F.col("event_type").alias("text"), box(x, x, x, x).alias("rect"), F.array(point(x + 1, x + 2), point(x + 5, x + 2), point(x + 1, x + 9), point(x + 5, x + 9)).alias("vertices"), colour.alias("stroke"))
    none = F.lit(None).cast("string")
    square = F.struct(F.lit(4).alias("kind"), F.lit("sq").alias("title"), none.alias("content"), none.alias("text"), box(x + 3, x + 3, x + 4, x + 4).alias("rect"), F.slice(mark["vertices"], 1, 0).alias("vertices"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("stroke"))
    both = F.array(mark, square)
    pages = read(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("page_no"), F.slice(both, F.lit(1), (F.col("event_id") % 3).cast("int")).alias("annotations"))
    rows = images.annotations(pages)
    return rows.select("doc_id", "page_no", "kind", "text", F.col("rect.x0").alias("x0"), F.col("rect.y1").alias("y1"), "is_candidate")


_CONFIG = {"redactors": [
    {"redactor_type": "LLMTextRedaction", "redaction_rules": [{"name": "names@", "label": "Names", "model": "m#", "system_prompt": "Extract terms.", "redaction_terms": ["People's names", "Number @"], "constraints": ["No places", "- No firms"]}, {"name": "dates", "model": "m2", "system_prompt": "Extract terms.", "redaction_terms": ["Dates of birth"]}]},
    {"redactor_type": "ImageLLMTextRedaction", "redaction_rules": [{"name": "i1", "text_redaction_rule": "names@", "constraints": []}, {"name": "i2", "text_redaction_rule": "dates", "model": "m9"}, {"name": "i3", "text_redaction_rule": "gone"}]},
    {"redactor_type": "ImageRedaction", "redaction_rules": [{"name": "i1"}]}, {"redactor_type": "Strange", "redaction_rules": [{"name": "s"}]},
]}


def _rules(spark, sf_dir):
    """A configuration for each user: names and models of its own, references that are there and that aren't."""
    users = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("config"), (F.col("user_id") % 3).cast("string").alias("m")).distinct()
    return rules.flattened(users.select("config", F.replace(F.replace(F.lit(json.dumps(_CONFIG)), F.lit("@"), "config"), F.lit("#"), "m").alias("body")))


RULE_SQL = f"""bodies AS (SELECT DISTINCT user_id::VARCHAR AS config, replace(replace({text(json.dumps(_CONFIG))}, '@', user_id::VARCHAR), '#', (user_id % 3)::VARCHAR)::JSON AS body FROM events),
cfg AS (SELECT config, unnest(range(4)) AS redactor_no, unnest(from_json(json_extract(body, '$.redactors'), '["JSON"]')) AS r FROM bodies),
rules AS (SELECT config, redactor_no, r->>'$.redactor_type' AS redactor_type, CAST(unnest(range(CAST(json_array_length(r, '$.redaction_rules') AS BIGINT))) AS INT) AS rule_no, unnest(from_json(json_extract(r, '$.redaction_rules'), '["JSON"]')) AS rule FROM cfg),
flat AS (SELECT config, CAST(redactor_no AS INT) AS redactor_no, rule_no, redactor_type, rule->>'$.name' AS name, rule->>'$.label' AS label, rule->>'$.model' AS model, rule->>'$.text_redaction_rule' AS base, rule->>'$.system_prompt' AS system_prompt,
  from_json(json_extract(rule, '$.redaction_terms'), '["VARCHAR"]') AS terms, from_json(json_extract(rule, '$.constraints'), '["VARCHAR"]') AS constraints FROM rules),
inherited AS (SELECT f.config, f.redactor_no, f.rule_no, f.redactor_type, f.name, coalesce(f.label, b.label) AS label, coalesce(f.model, b.model) AS model, coalesce(f.system_prompt, b.system_prompt) AS system_prompt, coalesce(f.terms, b.terms) AS terms, coalesce(f.constraints, b.constraints) AS constraints
  FROM flat f LEFT JOIN (SELECT * FROM flat WHERE redactor_type = 'LLMTextRedaction') b ON f.base = b.name AND f.config = b.config)"""


@query(f"WITH {RULE_SQL} SELECT config, redactor_no, rule_no, redactor_type, name, label, model, base AS text_redaction_rule FROM flat")
def config_flatten(spark, sf_dir):
    return _rules(spark, sf_dir).select("config", "redactor_no", "rule_no", "redactor_type", "name", "label", "model", "text_redaction_rule")


@query(f"WITH {RULE_SQL} SELECT config, redactor_no, rule_no, name, label, model, array_to_string(terms, '|') AS terms, array_to_string(constraints, '|') AS constraints FROM inherited")
def config_inherit(spark, sf_dir):
    return rules.inherited(_rules(spark, sf_dir)).select("config", "redactor_no", "rule_no", "name", "label", "model", F.array_join("redaction_terms", "|").alias("terms"), F.array_join("constraints", "|").alias("constraints"))


@query(f"WITH {RULE_SQL} SELECT config, name, 'reference ' || base AS problem FROM flat f WHERE base IS NOT NULL AND NOT EXISTS (SELECT 1 FROM flat b WHERE b.redactor_type = 'LLMTextRedaction' AND b.name = f.base AND b.config = f.config) UNION ALL SELECT config, name, 'type ' || redactor_type FROM flat WHERE redactor_type = 'Strange'")
def config_errors(spark, sf_dir):
    flat = _rules(spark, sf_dir)
    bad = rules.unknown_references(flat).select("config", "name", F.concat(F.lit("reference "), "text_redaction_rule").alias("problem"))
    return bad.unionByName(rules.unknown_types(flat, rules.APPLICABLE["pdf"]).select("config", "name", F.concat(F.lit("type "), "redactor_type").alias("problem")))


@query(f"WITH {RULE_SQL} SELECT config, name, count(*) AS n FROM flat GROUP BY config, name HAVING count(*) > 1")
def duplicate_rules(spark, sf_dir):
    return rules.duplicates(_rules(spark, sf_dir)).select("config", "name", "n")


@query("SELECT type_name, string_agg(provider, ',' ORDER BY provider) AS providers FROM (SELECT DISTINCT event_type || (user_id % 40) AS type_name, 'class' || (event_id % 3) AS provider FROM events) GROUP BY type_name HAVING count(*) > 1")
def duplicate_types(spark, sf_dir):
    """Types that several classes register, from events."""
    e = read(spark, sf_dir, "events")
    registered = e.select(F.concat("event_type", (F.col("user_id") % 40).cast("string")).alias("type_name"), F.concat(F.lit("class"), (F.col("event_id") % 3).cast("string")).alias("provider"))
    return rules.duplicate_types(registered).select("type_name", F.array_join("providers", ",").alias("providers"))


@query(f"WITH {RULE_SQL} SELECT config, redactor_type, count(*) AS n FROM flat WHERE redactor_type IN ('LLMTextRedaction', 'ImageRedaction', 'ImageTextRedaction', 'ImageLLMTextRedaction') GROUP BY config, redactor_type")
def applicable_rules(spark, sf_dir):
    return rules.applicable(_rules(spark, sf_dir), "pdf").groupBy("config", "redactor_type").agg(F.count("*").alias("n"))


_section = lambda tag, x: f"'<{tag}>' || chr(10) || array_to_string(list_transform({x}, lambda i: CASE WHEN starts_with(i, '-') THEN i ELSE '- ' || i END), chr(10)) || chr(10) || '</{tag}>'"


@query(f"WITH {RULE_SQL} SELECT config, name, concat_ws(chr(10) || chr(10), '<SystemRole>' || chr(10) || system_prompt || chr(10) || '</SystemRole>', {_section('Terms', 'terms')}, {text(rules.OUTPUT_FORMAT)}, CASE WHEN len(constraints) > 0 THEN {_section('Constraints', 'constraints')} END) AS prompt FROM inherited WHERE terms IS NOT NULL")
def system_prompts(spark, sf_dir):
    flat = rules.inherited(_rules(spark, sf_dir)).filter("redaction_terms IS NOT NULL")
    return flat.select("config", "name", rules.system_prompt(F.col("system_prompt"), F.col("redaction_terms"), F.col("constraints")).alias("prompt"))


@query("SELECT doc_id, md5('<Notes>' || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda i: CASE WHEN ends_with(i, '.') THEN i ELSE i || '.' END), chr(10)) || chr(10) || '</Notes>') AS section_md5 FROM documents")
def plain_sections(spark, sf_dir):
    """Texts in a tag, line by line, not as a list."""
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(xml_section("Notes", F.split("text", "\n"), as_list=False)).alias("section_md5"))


MODELS_WANTED, MODELS_THERE = "SELECT DISTINCT 'm' || user_id AS model FROM events WHERE event_type = 'view'", "SELECT DISTINCT 'm' || user_id AS model FROM events WHERE event_type = 'click' AND value > 20"


@query(f"SELECT model, CASE WHEN model IN ({MODELS_THERE}) THEN 'update' ELSE 'create' END AS action FROM ({MODELS_WANTED})")
def model_deployment(spark, sf_dir):
    return rules.deployment(derived(spark, sf_dir, MODELS_WANTED), derived(spark, sf_dir, MODELS_THERE))


@query("SELECT DISTINCT source, lang, md5(text) AS chunk_md5 FROM documents WHERE text <> 'Text Detection Failed'")
def distinct_chunks(spark, sf_dir):
    return read(spark, sf_dir, "documents").filter(F.col("text") != images.FAILED).select("source", "lang", F.md5("text").alias("chunk_md5")).distinct()


@query("SELECT doc_id, n_chars, nth FROM (SELECT doc_id, n_chars, source, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INT) AS nth FROM documents) WHERE nth <= 5")
def longest_by_source(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return read(spark, sf_dir, "documents").select("doc_id", "n_chars", F.row_number().over(w).alias("nth")).filter("nth <= 5")


@query("""SELECT 'only documents' AS side, count(*) AS n FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels)
UNION ALL SELECT 'both', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'either', count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)""")
def set_operations(spark, sf_dir):
    a, b = read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels").select("doc_id")
    n = lambda df, side: df.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return n(a.exceptAll(b), "only documents").unionByName(n(a.intersect(b), "both")).unionByName(n(a.union(b).distinct(), "either"))


_grey = "list_transform(embedding, lambda e: CAST(floor((CAST(e AS DOUBLE) + 1) * 100) AS INT))"


@query(f"""SELECT vec_id, sha256(encode((len(g) // 8)::VARCHAR || 'x8:') || unhex(array_to_string(list_transform(g, lambda v: repeat(printf('%02x', v), 3)), ''))) AS content_hash, 3 AS n_images, 3 AS n_contents
FROM (SELECT vec_id, {_grey} AS g FROM embeddings)""")
def image_rasters(spark, sf_dir):
    """Vectors as grey images of eight rows, each stored in three encodings: one image by its pixels."""

    def stored(grey: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([raster.encoded(np.array(g, np.uint8).reshape(8, -1), int(k), 9 - 2 * int(k)) for g, k in zip(grey, kind, strict=True)], dtype=object)

    grey = F.transform("embedding", lambda e: F.floor((e.cast("double") + 1) * 100).cast("int"))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", grey.alias("grey"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(4))).alias("kind"))
    kept = rows.select("vec_id", F.pandas_udf(stored, "binary")("grey", "kind").alias("content"))
    seen = images.with_pixel_hash(kept).groupBy("vec_id", "content_hash")
    return seen.agg(F.count("*").cast("int").alias("n_images"), F.countDistinct("content").cast("int").alias("n_contents"))
