"""DuckDB SQL for what SQL can say of the operators' results."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def words(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def crc32(text: str) -> str:
    """crc32 of a text of ASCII characters, a byte at a time and in it a bit at a time."""
    bit = "lambda c, unused: xor(c >> 1, 3988292384 * (c & 1))"
    step = f"lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], {bit})"
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), {step}), 4294967295)"


FOLD = crc32("doc_id::VARCHAR") + " % 5"

#: The shard of each key by the published loop, with 8 shards and with 9.
SHARDS = """
WITH RECURSIVE keys AS (SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, '')) + 1 AS size FROM documents),
jumps AS (
  SELECT r, n, coalesce(doc_id, 0)::HUGEINT AS k, -1::BIGINT AS b, 0::BIGINT AS j FROM keys, (VALUES (8), (9)) t(n)
  UNION ALL
  SELECT r, n, (k * 2862933555777941757 + 1) % 18446744073709551616, j,
    floor((j + 1) * (2147483648::DOUBLE / ((((k * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592) + 1)::DOUBLE))::BIGINT FROM jumps WHERE j < n),
last AS (SELECT r, n, max(b) AS shard FROM jumps WHERE j >= n GROUP BY r, n)
SELECT doc_id, size, 'key' AS law, a.shard::INT AS shard, g.shard::INT AS grown_shard, count(*) OVER (PARTITION BY a.shard) AS shard_rows
FROM keys JOIN last a ON a.r = keys.r AND a.n = 8 JOIN last g ON g.r = keys.r AND g.n = 9"""

_digits = "regexp_replace(x, '[^0-9]', '', 'g')"
_luhn = f"""list_sum(list_transform(range(length({_digits})), lambda i:
  CASE WHEN i % 2 = 0 THEN substr(reverse({_digits}), i + 1, 1)::INT ELSE substr(reverse({_digits}), i + 1, 1)::INT * 2 - CASE WHEN substr(reverse({_digits}), i + 1, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""

#: How many identifiers of each kind the base patterns find.
PII_COUNTS = rf"""
SELECT doc_id,
  len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
  len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: len(list_filter(string_split(x, '.'), lambda p: coalesce(try_cast(p AS HUGEINT), 256) > 255)) = 0)) AS n_ip,
  len(list_filter(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: length({_digits}) BETWEEN 14 AND 19 AND {_luhn})) AS n_card,
  len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length({_digits}) BETWEEN 10 AND 15)) AS n_phone
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""

#: Targets of sources: filled up one after the other in the order in which they are full.
TARGETS = f"""
WITH docs AS (SELECT doc_id, source, len({words("coalesce(text, '')")}) AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
ranked AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM sources),
filled AS (SELECT *, 3.0 * source_size / w AS full_at FROM ranked),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3.0 * source_size) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM filled),
chosen AS (SELECT coalesce(min_by(level, full_at) FILTER (level <= full_at), max(full_at)) AS level FROM levels)
SELECT doc_id, size, source_size, round(least(chosen.level * w, 3.0 * source_size), 3)::DOUBLE AS target FROM docs JOIN filled ON docs.source IS NOT DISTINCT FROM filled.source, chosen"""

#: Tokens, counts of the training part, and the base score to six digits.
LM_BASE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {FOLD} = 1 AS held_out, list_append({words(LOWER)}, chr(10)) AS ts FROM documents),
tokens AS (SELECT r, held_out, unnest(ts) AS t FROM docs),
counts AS (SELECT t, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY t),
sums AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM counts),
scored AS (SELECT r, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))) AS s FROM tokens LEFT JOIN counts USING (t), sums GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(s, 6) AS base_score FROM docs JOIN scored USING (r), sums"""

#: The base counts of the quality rules.
QUALITY_BASE = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {words("coalesce(text, '')")} AS ws FROM documents),
grams AS (SELECT r, unnest(range(len(ws) - 2)) AS i, unnest(list_transform(range(len(ws) - 2), lambda i: [ws[i + 1], ws[i + 2], ws[i + 3]])) AS g FROM docs WHERE len(ws) > 2),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) t(k) GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM docs),
doubles AS (SELECT r, sum(c - 1)::BIGINT AS n FROM (SELECT r, l, count(*) AS c FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r, l) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(doubles.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
  len(ws) < 50 OR 100 * coalesce(covered.n, 0) > 50 * len(ws) AS base_failed
FROM docs LEFT JOIN covered USING (r) LEFT JOIN doubles USING (r)"""

#: All distances; the ten least of each query.
NEAREST = """
WITH good AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.v, c.v) AS score FROM good q JOIN good c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank, vec_id, round(score, 9) AS score FROM pairs)
SELECT * FROM ranked WHERE rank <= 10"""

HELD_OUT = f"SELECT doc_id, {FOLD} = 0 AS held_out, true AS in_range FROM documents"

#: Words of letters, digits and all beyond ASCII.
_ALNUM = f"regexp_extract_all({LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
_step = "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, unused: xor(c >> 1, 3988292384 * (c & 1)))"
_bytes = "list_transform(range(length(hex(encode(w))) // 2), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)"

#: Buckets of words, gains by what both sides count, and the draw by score.
RESAMPLED = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS ws FROM documents),
wanted AS (SELECT unnest({_ALNUM}) AS w FROM benchmark),
tokens AS (SELECT r, unnest(ws) AS w FROM docs),
known AS (SELECT w, xor(list_reduce(list_concat([4294967295], {_bytes}), {_step}), 4294967295) % 10000 AS bucket FROM (SELECT w FROM tokens UNION SELECT w FROM wanted)),
s AS (SELECT bucket, count(*) AS n FROM tokens JOIN known USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM wanted JOIN known USING (w) GROUP BY bucket),
alls AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t_all),
gains AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + 10000) / ((s.n + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), alls),
weights AS (SELECT r, sum(gain)::BIGINT AS weight FROM tokens JOIN known USING (w) JOIN gains USING (bucket) GROUP BY r),
scored AS (SELECT r, doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
  + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM docs LEFT JOIN weights USING (r)),
places AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN places USING (r)"""

#: Windows of items, by their lengths, and the documents' words inside their occurrences.
CONTAMINATED = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS ws FROM documents),
items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_ALNUM} AS ws FROM benchmark),
windows AS (SELECT DISTINCT item, least(10, len(ws)) AS size, unnest(list_transform(range(1, len(ws) - least(10, len(ws)) + 2), lambda i: array_to_string(ws[i:i + least(10, len(ws)) - 1], ' '))) AS w FROM items WHERE len(ws) > 0),
runs AS (SELECT r, size, unnest(range(1, len(ws) - size + 2)) AS p, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS w
  FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(ws) >= size),
met AS (SELECT r, p, runs.size, item FROM runs JOIN windows USING (w) WHERE runs.size = windows.size),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + size)) AS k FROM (SELECT DISTINCT r, p, size FROM met)) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS names FROM met GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)"""

#: The fit list's size and each row's deviation, once a component.
DEVIATIONS = """
WITH good AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor(c::DOUBLE * 256)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
distinct_x AS (SELECT DISTINCT x FROM good),
sums AS (SELECT size, i, count(*) AS n, sum(v)::HUGEINT AS s FROM (SELECT len(x) AS size, unnest(x) AS v, unnest(range(len(x))) AS i FROM distinct_x) GROUP BY size, i),
per AS (SELECT r, vec_id, len(x) AS size, unnest(x) AS v, unnest(range(len(x))) AS i FROM good),
devs AS (SELECT r, vec_id, size, max(n) AS n, sum((n * v - s) * (n * v - s))::BIGINT AS deviation FROM per JOIN sums USING (size, i) GROUP BY r, vec_id, size)
SELECT vec_id, unnest(range(1, least(size, 4) + 1))::INT AS component, n, deviation FROM devs"""
