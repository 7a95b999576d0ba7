"""Registration of queries together with their SQL, and SQL that several share."""

from __future__ import annotations

import re

from ..functions.text import BLANK, DROPPED, NARROW, PLAIN_MORE, PLAIN_ONE, PUNCT

TABLES = {"customer", "documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events", "lineitem", "nation", "orders", "part", "region", "supplier"}
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) by its name, with the DuckDB SQL for the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def read(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(value: str) -> str:
    """A string as an SQL literal."""
    return "'" + value.replace("'", "''") + "'"


def chars(value: str) -> str:
    """A string as SQL, characters that a literal can't show by number."""
    parts = [f"chr({ord(c)})" if ord(c) < 32 or ord(c) > 126 else text(c) for c in value]
    return "(" + " || ".join(parts) + ")"


def derived(spark, sf_dir: str, sql: str):
    """Rows of a SELECT over the given tables, in words that DuckDB has as well."""
    names = sorted(set(re.findall(r"\b(?:FROM|JOIN) (\w+)", sql)) & TABLES)
    for name in names:
        read(spark, sf_dir, name).createOrReplaceTempView(f"given_{name}")
    return spark.sql(re.sub(r"\b(FROM|JOIN) (\w+)", lambda m: f"{m[1]} given_{m[2]}" if m[2] in TABLES else m[0], sql))


_blank, _punct = chars(BLANK), text(PUNCT)


def sql_plain(x: str) -> str:
    out = f"translate({x}, {text(''.join(PLAIN_ONE))}, {text(''.join(PLAIN_ONE.values()))})"
    for k, v in PLAIN_MORE.items():
        out = f"replace({out}, {text(k)}, {text(v)})"
    return out


def sql_normal(x: str) -> str:
    return f"trim(trim(lower({sql_plain(x)}), {_blank}), {_punct})"


def sql_words(x: str) -> str:
    return f"list_filter(list_transform(string_split({sql_normal(x)}, ' '), lambda w: trim(trim(w, {_blank}), {_punct})), lambda w: w <> '')"


def sql_clean(x: str) -> str:
    return f"trim(translate({x}, {chars(NARROW + DROPPED)}, ' '), {_blank})"


LINES = f"""
lists AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_words("x")}), lambda x: len(x) > 0) AS ws FROM documents),
lines AS (SELECT doc_id, CAST(unnest(range(len(ws))) AS INT) AS line_no, unnest(ws) AS words FROM lists),
boxed AS (SELECT doc_id, line_no, line_no // 10 AS page_no, line_no % 10 AS line_in_page, words, (20 * (line_no % 10))::DOUBLE AS y0, (20 * (line_no % 10) + 10)::DOUBLE AS y1 FROM lines)"""
TOKENS = LINES + """,
exploded AS (SELECT doc_id, line_no, CAST(unnest(range(len(words))) AS INT) AS pos, unnest(words) AS word FROM lines),
tokens AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no, pos) - 1 AS INT) AS gpos FROM exploded)"""
#: Terms to look for: every phrase between marks or line ends of every benchmark item, long and short.
PHRASES = "[.,;:!?\\n]+"
TERM_SQL = f"""SELECT item_id * 1000 + i AS term_id, trim(p) AS term FROM (
  SELECT item_id, unnest(range(len(ps))) AS i, unnest(ps) AS p FROM (SELECT item_id, regexp_split_to_array(text, '{PHRASES}') AS ps FROM benchmark)) WHERE trim(p) <> ''"""
_stem = "rtrim(rtrim({0}, 's'), chr(39))"
_two = "list_concat(list_concat(ws[:i], [substr(ws[i + 1], 1, k - 1), substr(ws[i + 1], k + 1)]), ws[i + 2:])"
#: All places of terms: every word of the documents that can be a word of a term, by place, and all of a term's words there.
TERMS = f""",
terms AS ({TERM_SQL}),
plain AS (SELECT term_id, {sql_words("term")} AS ws FROM terms),
cuts AS (SELECT term_id, ws, i, unnest(list_filter(range(2, greatest(3, length(ws[i + 1]))), lambda k: substr(ws[i + 1], k, 1) = '-')) AS k FROM (SELECT term_id, ws, unnest(range(len(ws))) AS i FROM plain)),
readings AS (SELECT term_id, 0 AS reading, ws, -1 AS split FROM plain WHERE len(ws) > 0
  UNION ALL SELECT term_id, row_number() OVER (PARTITION BY term_id ORDER BY i, k) AS reading, {_two} AS ws, i AS split FROM cuts),
term_words AS (SELECT term_id, reading, split, len(ws) AS n, unnest(range(len(ws))) AS off, unnest(ws) AS w FROM readings),
known AS (SELECT DISTINCT word FROM tokens),
forms AS (SELECT word, term_id, reading, split, n, off, word = w AS equal, (word = w OR {_stem.format("word")} = w) AS stem, w || chr(39) || 's' = word AS possessive,
    length(w) >= 4 AND word <> w AND ends_with(word, w) AND off = 0 AS before, length(w) >= 4 AND word <> w AND starts_with(word, w) AND off = n - 1 AS after
  FROM known JOIN term_words ON word = w OR {_stem.format("word")} = w OR (n > 1 AND length(w) >= 4 AND ((off = 0 AND ends_with(word, w)) OR (off = n - 1 AND starts_with(word, w))))),
hits AS (SELECT doc_id, term_id, reading, split, n, off, gpos - off AS start, line_no, equal, stem, possessive, before, after FROM tokens JOIN forms USING (word)),
judged AS (SELECT *, min(CASE WHEN off = 0 THEN line_no END) OVER w AS line, max(CASE WHEN off = n - 1 THEN line_no END) OVER w AS last_line,
    max(CASE WHEN off = split THEN line_no END) OVER w AS cut_line, max(CASE WHEN off = split + 1 THEN line_no END) OVER w AS rest_line
  FROM hits WINDOW w AS (PARTITION BY doc_id, term_id, reading, start)),
starts AS (SELECT doc_id, term_id, reading, start, any_value(n) AS n FROM judged
  WHERE CASE WHEN n = 1 THEN equal OR possessive WHEN split >= 0 OR line_no <> line THEN equal ELSE stem OR before OR (after AND last_line = line) END AND (split < 0 OR cut_line < rest_line)
  GROUP BY doc_id, term_id, reading, start HAVING count(*) = any_value(n)),
singles AS (SELECT s.doc_id, term_id, line_no, pos, word FROM starts s JOIN tokens k ON s.doc_id = k.doc_id AND s.start = k.gpos WHERE n = 1),
spans AS (SELECT s.doc_id, term_id, reading, start, line_no, min(pos) AS first, max(pos) AS last FROM starts s JOIN tokens k ON s.doc_id = k.doc_id AND gpos BETWEEN start AND start + n - 1 GROUP BY s.doc_id, term_id, reading, start, line_no),
boxes AS (
  SELECT doc_id, term_id, start, page_no, line_no,
    CASE WHEN first > 0 THEN length(array_to_string(list_slice(words, 1, first), ' ')) + 1 ELSE 0 END::DOUBLE AS x0, y0,
    length(array_to_string(list_slice(words, 1, last + 1), ' '))::DOUBLE AS x1, y1
  FROM spans JOIN boxed USING (doc_id, line_no))"""


def terms_of(spark, sf_dir: str):
    """The terms of TERM_SQL."""
    from pyspark.sql import functions as F

    phrases = read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", PHRASES.replace("\\n", "\n"))).alias("i", "p"))
    return phrases.select((F.col("item_id") * 1000 + F.col("i")).alias("term_id"), F.trim("p").alias("term")).filter("term <> ''")


def sql_language(table: str = "documents", threshold: float = 0.9, margin: float = 0.2) -> str:
    """CTEs that fit trigrams on the labelled documents and end in gate (doc_id, is_english)."""
    from ..operators.language import EVIDENCE, LANGUAGES, OTHERS, SAMPLE, SMOOTHING

    each = lambda f, sep=", ": sep.join(f.format(c=c) for c in LANGUAGES)
    grams = "unnest(list_transform(range(1, len(a) - 1), lambda i: a[i] || a[i + 1] || a[i + 2]))"
    others = ", ".join(f"p_{c}" for c in LANGUAGES if c != "en")
    return f"""spelled AS (SELECT doc_id, text, lang, string_split(' ' || trim(regexp_replace(lower(text), '{OTHERS}', ' ', 'g')) || ' ', '') AS a FROM {table} WHERE text IS NOT NULL),
sample AS (SELECT lang, a FROM spelled WHERE lang IN ({each("'{c}'")}) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) <= {SAMPLE}),
sample_counts AS (SELECT gram, {each("count(*) FILTER (lang = '{c}') AS {c}")} FROM (SELECT lang, {grams} AS gram FROM sample WHERE len(a) > 2) GROUP BY gram),
sample_totals AS (SELECT {each("coalesce(sum({c}), 0) AS n_{c}")}, count(*) AS kinds FROM sample_counts),
model AS (SELECT gram, {each("ln(({c} + " + str(SMOOTHING) + "::DOUBLE) / (n_{c} + " + str(SMOOTHING) + "::DOUBLE * (kinds + 1))) AS {c}")} FROM (SELECT * FROM sample_counts UNION ALL SELECT '', {each("0")}), sample_totals),
summed AS (SELECT doc_id, count(*) AS n, {each("sum(coalesce(m.{c}, u.{c})) AS s_{c}")} FROM (SELECT doc_id, {grams} AS gram FROM spelled WHERE len(a) > 2) LEFT JOIN model m USING (gram), (SELECT * FROM model WHERE gram = '') u GROUP BY doc_id),
powers AS (SELECT doc_id, {each("exp((s_{c} - greatest(" + each("s_{c}") + ")) / n * least(n, " + str(EVIDENCE) + ")) AS e_{c}")} FROM summed),
told AS (SELECT doc_id, {each("e_{c} / (" + each("e_{c}", " + ") + ") AS p_{c}")} FROM powers),
held AS (SELECT doc_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS plain, p_en, greatest({others}) AS p_other FROM {table} LEFT JOIN told USING (doc_id)),
gate AS (SELECT doc_id, text, text IS NULL OR coalesce(length(plain) >= 20 AND len(string_split(plain, ' ')) >= 3 AND p_en >= {threshold} AND p_en - p_other >= {margin}, false) AS is_english FROM held)"""
