"""Queries on evaluation, jobs and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import PUNCT, job_base, job_version, pdf_date, service_label, snake_case
from ..operators import evaluation, jobs, metrics
from .base import derived, query, read, text

# Proposals are the e-mails, phones and addresses of documents; finals those of even documents, a few of them missing.
PROPOSED = """proposed AS (SELECT doc_id, i // 3 AS page_no, terms[i + 1] AS text, (20 * i)::DOUBLE AS y0, (20 * i + 10)::DOUBLE AS y1, i FROM
 (SELECT doc_id, terms, CAST(unnest(range(len(terms))) AS INT) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+[.-][0-9.-]+') AS terms FROM documents)))"""
FINAL = "final AS (SELECT doc_id, page_no, '(' || text || ').' AS text, y0, y1 FROM proposed WHERE doc_id % 3 <> 0 OR i % 2 = 0 UNION ALL SELECT doc_id, page_no, 'added', y0, y1 FROM proposed WHERE i % 3 = 1)"


def _sides(spark, sf_dir):
    terms = F.regexp_extract_all("text", F.lit("([0-9]+[.-][0-9.-]+)"), 0)
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(terms).alias("i", "text"))
    proposed = rows.select("doc_id", F.floor(F.col("i") / 3).cast("int").alias("page_no"), "text", (20.0 * F.col("i")).alias("y0"), (20.0 * F.col("i") + 10).alias("y1"), "i")
    columns = ("doc_id", "page_no", "text", "y0", "y1")
    some = proposed.filter("doc_id % 3 <> 0 OR i % 2 = 0").withColumn("text", F.concat(F.lit("("), "text", F.lit(")."))).select(*columns)
    return proposed.select(*columns), some.unionByName(proposed.filter("i % 3 = 1").withColumn("text", F.lit("added")).select(*columns))


SAME = f"p.doc_id = f.doc_id AND p.page_no = f.page_no AND trim(p.text, {text(PUNCT)}) = trim(f.text, {text(PUNCT)}) AND abs(p.y0 - f.y0) <= 1e-9 * greatest(abs(p.y0), abs(f.y0)) AND abs(p.y1 - f.y1) <= 1e-9 * greatest(abs(p.y1), abs(f.y1))"
COUNTS = """nf AS (SELECT f.doc_id, count(*) AS nf FROM final f SEMI JOIN proposed p ON p.doc_id = f.doc_id AND p.page_no = f.page_no GROUP BY f.doc_id),
np AS (SELECT doc_id, count(*) AS n FROM proposed GROUP BY doc_id)
SELECT doc_id, n AS n_proposed, CAST(coalesce(nf, 0) AS BIGINT) AS n_final, CAST(coalesce(tp, 0) AS BIGINT) AS true_positives, CAST(n - coalesce(tp, 0) AS BIGINT) AS false_positives, CAST(coalesce(nf, 0) - coalesce(tp, 0) AS BIGINT) AS false_negatives FROM np LEFT JOIN nf USING (doc_id) LEFT JOIN tp USING (doc_id)"""


@query(f"WITH {PROPOSED}, {FINAL}, tp AS (SELECT p.doc_id, count(*) AS tp FROM proposed p SEMI JOIN final f ON {SAME} GROUP BY p.doc_id), {COUNTS}")
def compare_redactions(spark, sf_dir):
    return evaluation.compare(*_sides(spark, sf_dir))


@query(f"""WITH {PROPOSED}, {FINAL}, a AS (SELECT doc_id, page_no, trim(text, {text(PUNCT)}) AS t, round(y0, 6) AS y, count(*) AS n FROM proposed GROUP BY ALL),
b AS (SELECT doc_id, page_no, trim(text, {text(PUNCT)}) AS t, round(y0, 6) AS y, count(*) AS m FROM final GROUP BY ALL),
tp AS (SELECT doc_id, sum(least(n, m)) AS tp FROM a JOIN b USING (doc_id, page_no, t, y) GROUP BY doc_id), {COUNTS}""")
def compare_one_to_one(spark, sf_dir):
    return evaluation.compare(*_sides(spark, sf_dir), match="one_to_one")


@query(f"WITH {PROPOSED}, {FINAL} SELECT p.doc_id, p.page_no, p.text FROM proposed p ANTI JOIN final f ON {SAME}")
def false_positives(spark, sf_dir):
    return evaluation.false_positives(*_sides(spark, sf_dir)).select("doc_id", "page_no", "text")


@query("""WITH e AS (SELECT b.doc_id, a.t AS term FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]{9,}')) AS t FROM documents) a JOIN documents b ON b.doc_id = a.doc_id + 1),
c AS (SELECT doc_id, count(*) AS n_expected, count(*) FILTER (contains(lower(text), lower(term))) AS n_found FROM e JOIN documents USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n_expected, n_found, n_found / n_expected AS ratio, n_found / n_expected > 0.5 OR abs(n_found / n_expected - 0.5) <= 0.1 * greatest(n_found / n_expected, 0.5) AS passes FROM c""")
def match_ratio(spark, sf_dir):
    """Of each document the long words of the one before: some are there, others aren't."""
    docs = read(spark, sf_dir, "documents")
    expected = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{9,})"), 1)).alias("term"))
    return evaluation.match_ratio(expected, docs, 0.5)


@query(f"WITH {PROPOSED} SELECT doc_id, count(p.text) AS n_annotations, count(DISTINCT page_no) AS n_pages FROM documents d LEFT JOIN proposed p USING (doc_id) GROUP BY doc_id")
def annotation_counts(spark, sf_dir):
    proposed, _ = _sides(spark, sf_dir)
    return read(spark, sf_dir, "documents").select("doc_id").join(proposed, "doc_id", "left").groupBy("doc_id").agg(F.count("text").alias("n_annotations"), F.countDistinct("page_no").alias("n_pages"))


#: Ids of jobs, from events: with a version, without, with characters that folders can't have, too long, none.
IDS = """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'a' || user_id || ':' || (event_id % 50) || '-' || event_id WHEN 1 THEN 'uuid' || event_id || ':5' WHEN 2 THEN '..' || event_type || '|y?' || user_id || '.' WHEN 3 THEN 'b' || user_id || ':x-1'
 WHEN 4 THEN 'c:' || user_id || '-3-4' WHEN 5 THEN 'tab' || chr(9) || event_type || '<f>' || event_id WHEN 6 THEN repeat('z', CAST(event_id % 97 AS INT)) END AS id FROM events"""
_clean = """trim(regexp_replace(regexp_replace({0}, '[\\x00-\\x1f\\x7f]', '', 'g'), '["\\\\:|<>*?]', '-', 'g'), '.')"""
_version = "CASE WHEN len(string_split(id, ':')) = 2 AND len(string_split(string_split(id, ':')[2], '-')) = 2 AND regexp_full_match(string_split(string_split(id, ':')[2], '-')[1], '[0-9]+') THEN CAST(string_split(string_split(id, ':')[2], '-')[1] AS INT) END"


@query(f"SELECT event_id, id, CASE WHEN length(id) <= 60 THEN {_clean.format('id')} END AS folder, CASE WHEN {_version} IS NOT NULL THEN {_clean.format("string_split(id, ':')[1]")} ELSE {_clean.format('id')} END AS base, {_version} AS version FROM ({IDS})")
def job_ids(spark, sf_dir):
    i = F.col("id")
    return derived(spark, sf_dir, IDS).select("event_id", "id", jobs.job_folder(i).alias("folder"), job_base(i).alias("base"), job_version(i).alias("version"))


# Blobs of jobs, from events: a user is a job, its events are versions.
BLOBS = "blobs AS (SELECT 'job' || user_id AS base, CAST(event_id % 9 AS INT) AS version, 'job' || user_id || '-' || (event_id % 9) || '/' || event_type || '/proposed_redactions.json' AS name, ts AS created FROM events)"


def _blobs(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    base = F.concat(F.lit("job"), F.col("user_id").cast("string"))
    version = (F.col("event_id") % 9).cast("int")
    return e.select(base.alias("base"), version.alias("version"), F.concat(base, F.lit("-"), version.cast("string"), F.lit("/"), "event_type", F.lit("/proposed_redactions.json")).alias("name"), F.col("ts").alias("created"))


@query(f"WITH {BLOBS}, j AS (SELECT DISTINCT base, version FROM blobs WHERE version > 2) SELECT j.base, j.version, max_by(b.name, (b.version, b.created, b.name)) AS name, max(b.version) AS from_version FROM j JOIN blobs b ON j.base = b.base AND b.version <= j.version - 2 AND b.version >= 1 GROUP BY j.base, j.version")
def job_versions(spark, sf_dir):
    blobs = _blobs(spark, sf_dir)
    return jobs.proposal_before(blobs.select("base", "version").distinct(), blobs)


@query(f"WITH {BLOBS} SELECT base AS folder, max_by(name, (created, name)) AS name FROM blobs WHERE name LIKE '%click/proposed_redactions.json' GROUP BY base")
def latest_proposal(spark, sf_dir):
    return jobs.latest(_blobs(spark, sf_dir).withColumnRenamed("base", "folder"), "click/proposed_redactions.json")


TIMED = """timed AS (SELECT event_id AS job_id, ts AS started, CASE WHEN event_id % 7 > 0 THEN ts + to_seconds(CAST(floor(value * 60) AS BIGINT)) END AS ended, CASE WHEN event_id % 2 = 0 THEN 10.0 END::DOUBLE AS timeout_minutes,
 CASE event_id % 3 WHEN 0 THEN 'ALPHA' WHEN 1 THEN 'BETA_SERVICE' END AS service, CASE WHEN event_id % 5 > 0 THEN upper(event_type) END AS stage FROM events),
outcomes AS (SELECT *, started + to_seconds(CAST(coalesce(timeout_minutes, 180) * 60 AS BIGINT)) AS deadline FROM timed),
judged AS (SELECT *, CASE WHEN ended IS NOT NULL AND ended <= deadline THEN 'DONE' ELSE 'TIMED_OUT' END AS outcome FROM outcomes)"""


def _timed(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    i = F.col("event_id")
    return jobs.timed(e.select(
        i.alias("job_id"), F.col("ts").alias("started"),
        F.when(i % 7 > 0, F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.floor(F.col("value") * 60).cast("long") * 1000000)).alias("ended"),
        F.when(i % 2 == 0, F.lit(10.0)).alias("timeout_minutes"),
        F.when(i % 3 == 0, "ALPHA").when(i % 3 == 1, "BETA_SERVICE").alias("service"), F.when(i % 5 > 0, F.upper("event_type")).alias("stage"),
    ).withColumn("started", F.col("started").cast("timestamp")))


@query(f"WITH {TIMED} SELECT job_id, outcome, epoch_us(deadline) AS deadline_us FROM judged")
def job_timeout(spark, sf_dir):
    return _timed(spark, sf_dir).select("job_id", "outcome", F.unix_micros("deadline").alias("deadline_us"))


@query(f"WITH {TIMED} SELECT job_id AS id, coalesce(stage, 'UNKNOWN') AS stage, 'FAIL' AS status, translate(lower(service), '_', '-') AS subject, 'Job ' || job_id || ' timed out' AS message FROM judged WHERE outcome = 'TIMED_OUT' AND service IS NOT NULL")
def failure_notices(spark, sf_dir):
    return jobs.failure_notices(_timed(spark, sf_dir))


@query(f"WITH {TIMED} SELECT translate(lower(service), '_', '-') AS subject, count(*) AS n FROM judged WHERE service = 'BETA_SERVICE' GROUP BY 1")
def topic_routing(spark, sf_dir):
    rows = _timed(spark, sf_dir).withColumn("subject", service_label(F.col("service")))
    return rows.filter("subject = 'beta-service'").groupBy("subject").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id AS job_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events) WHERE nth = 1")
def job_dedupe(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("job_id", F.col("user_id")).withColumn("at", F.struct("ts", "event_id"))
    return jobs.first_requests(e, "at").select("event_id", "job_id")


@query("SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def message_ttl(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.alive(e, e.agg(F.max("ts")).scalar()).select("event_id")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN CASE WHEN age >= 7 THEN 'DELETE' ELSE 'HOT' END WHEN 1 THEN CASE WHEN age >= 60 THEN 'ARCHIVE' WHEN age >= 30 THEN 'COLD' ELSE 'HOT' END WHEN 2 THEN CASE WHEN age >= 1 THEN 'DELETE' ELSE 'HOT' END ELSE 'HOT' END AS tier
FROM (SELECT event_id, CAST(event_id % 90 AS INT) AS age FROM events)""")
def retention_tier(spark, sf_dir):
    container = F.element_at(F.array(*[F.lit(x) for x in ("redactiondata", "analytics", "test", "other")]), (F.col("event_id") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", jobs.retention(container, F.col("event_id") % 90).alias("tier"))


#: Ended jobs, from events: some failed, some with faults beside.
RESPONSES = """SELECT CAST(event_id AS STRING) AS job_id, CASE event_id % 3 WHEN 0 THEN 'ANALYSE' WHEN 1 THEN 'REDACT' ELSE 'SANITISE' END AS stage, CASE WHEN event_id % 4 = 0 THEN event_type || ' failed' END AS error,
 CASE WHEN event_id % 5 = 0 THEN 'bus down' END AS bus_warning, CASE WHEN event_id % 7 = 0 THEN 'no metrics of ' || user_id END AS metrics_warning, CASE WHEN event_id % 11 = 0 THEN 'no exceptions' END AS exception_warning, CASE WHEN event_id % 13 = 0 THEN 'no log' END AS log_warning FROM events"""


@query(f"""SELECT job_id, stage, CASE WHEN error IS NULL THEN 'SUCCESS' ELSE 'FAIL' END AS status, CASE WHEN error IS NOT NULL THEN 'Redaction process failed with the following error: ' || error || CASE WHEN w <> '' THEN chr(10) || 'Additionally, the following non-fatal errors occurred:' || chr(10) || w ELSE '' END
  WHEN w <> '' THEN 'Redaction process completed successfully, but had some non-fatal errors:' || chr(10) || w ELSE 'Redaction process complete' END AS message FROM ({RESPONSES}), LATERAL (SELECT concat_ws(chr(10), bus_warning, metrics_warning, exception_warning, log_warning) AS w)""")
def job_response(spark, sf_dir):
    return jobs.responses(derived(spark, sf_dir, RESPONSES))


#: Bodies of requests, from events: whole, not JSON, with parts missing or unknown.
BODIES = """SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN '{"fileKind":"pdf","extra":' || user_id || '}' WHEN 1 THEN '{bad' || event_type WHEN 2 THEN '{"fileKind":"pdf","service":"ALPHA","readDetails":{"storageKind":"AzureBlob","properties":{"a":"' || event_type || '"}}}'
 WHEN 3 THEN '{"service":"NONE","writeDetails":{"storageKind":"AzureBlob"}}' ELSE '{"fileKind":"pdf","readDetails":{"properties":{}}}' END AS body FROM events"""


@query("SELECT event_id AS id, CASE event_id % 5 WHEN 1 THEN 'not JSON; fileKind is missing' WHEN 3 THEN 'fileKind is missing; service is unknown; writeDetails.properties is missing' WHEN 4 THEN 'readDetails.storageKind is missing' ELSE '' END AS errors FROM events")
def payload_errors(spark, sf_dir):
    return derived(spark, sf_dir, BODIES).select("id", F.array_join(jobs.payload_errors(F.col("body")), "; ").alias("errors"))


ROUTES = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'redact' WHEN 1 THEN 'apply' WHEN 2 THEN 'sanitise' ELSE event_type END AS route FROM events"


@query(f"SELECT event_id, route, CASE route WHEN 'redact' THEN 'ANALYSE' WHEN 'apply' THEN 'REDACT' WHEN 'sanitise' THEN 'SANITISE' END AS stage FROM ({ROUTES})")
def request_routes(spark, sf_dir):
    return derived(spark, sf_dir, ROUTES).withColumn("stage", jobs.stage_of(F.col("route")))


#: What the orchestrator says of jobs, from events.
STATUSES = """SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN '{"runtimeStatus":"Failed"}' WHEN 1 THEN '{"runtimeStatus":"Completed","output":{"status":"FAIL","by":"' || event_type || '"}}' WHEN 2 THEN '{"runtimeStatus":"Completed","output":{"status":"SUCCESS"}}'
 WHEN 3 THEN '{"runtimeStatus":"Running","errorMessage":"' || CASE WHEN user_id % 2 = 0 THEN event_type ELSE '' END || '"}' WHEN 4 THEN '{"runtimeStatus":"Terminated"}' ELSE '{}' END AS s FROM events"""


@query(f"SELECT id, coalesce(json_extract_string(s, '$.runtimeStatus') IN ('Failed', 'Terminated'), false) OR coalesce(length(json_extract_string(s, '$.errorMessage')) > 0, false) OR coalesce(json_extract_string(s, '$.output.status') = 'FAIL', false) AS failed FROM ({STATUSES})")
def job_outcomes(spark, sf_dir):
    return derived(spark, sf_dir, STATUSES).select("id", jobs.is_app_failure(F.col("s")).alias("failed"))


CODES = "SELECT event_id, CAST(200 + event_id % 400 AS INT) AS code FROM events"


@query(f"SELECT event_id, code, code >= 500 OR code IN (408, 429) AS fault FROM ({CODES})")
def service_faults(spark, sf_dir):
    return derived(spark, sf_dir, CODES).select("event_id", "code", jobs.is_service_fault(F.col("code")).alias("fault"))


@query("SELECT user_id AS job_id, md5(string_agg(event_type || ' ' || event_id, chr(10) || chr(10) || chr(10) ORDER BY event_id)) AS log_md5 FROM events GROUP BY user_id")
def exception_log(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.concat_ws(" ", "event_type", "event_id").alias("message"))
    return jobs.exception_log(e).select("job_id", F.md5("log").alias("log_md5"))


@query("SELECT key AS metric, sum(TRY_CAST(value AS DOUBLE)) AS total FROM (SELECT unnest(map_entries(m), recursive := true) FROM (SELECT MAP {'k': json_extract_string(props, '$.k'), event_type: CAST(event_id % 5 AS VARCHAR), 'name': event_type} AS m FROM events)) WHERE TRY_CAST(value AS DOUBLE) IS NOT NULL GROUP BY key")
def combine_metrics(spark, sf_dir):
    return metrics.combined(_metrics(spark, sf_dir))


def _metrics(spark, sf_dir):
    m = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.col("event_type"), (F.col("event_id") % 5).cast("string"), F.lit("name"), F.col("event_type"))
    return read(spark, sf_dir, "events").select(m.alias("metrics"))


@query("""WITH s AS (SELECT event_type AS metric, sum(event_id % 5)::DOUBLE AS total FROM events GROUP BY event_type) SELECT * FROM s UNION ALL SELECT 'total_redaction_results', count(*)::DOUBLE FROM events""")
def rule_metrics(spark, sf_dir):
    sums = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric")).agg(F.sum(F.col("event_id") % 5).cast("double").alias("total"))
    return metrics.with_count(sums, F.lit(read(spark, sf_dir, "events").count()))


CALLS = "calls AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'gpt-4.1' ELSE 'gpt-5.6-luna' END AS model, CAST(length(text) AS BIGINT) AS prompt_tokens, CAST(length(role) AS BIGINT) AS completion_tokens FROM conversations), priced AS (SELECT *, (prompt_tokens * 149 + completion_tokens * 593) / 1e6 AS cost FROM calls)"


def _calls(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    calls = c.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, "gpt-4.1").otherwise("gpt-5.6-luna").alias("model"), F.length("text").cast("long").alias("prompt_tokens"), F.length("role").cast("long").alias("completion_tokens"))
    return metrics.priced(calls, spark.createDataFrame(metrics.MODELS, metrics.MODEL_COLUMNS))


@query(f"WITH {CALLS} SELECT model, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, round(sum(cost), 6) AS cost FROM priced GROUP BY model")
def llm_cost(spark, sf_dir):
    return _calls(spark, sf_dir).groupBy("model").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.round(F.sum("cost"), 6).alias("cost"))


@query(f"WITH {CALLS} SELECT conv_id, turn, round(cost, 6) AS cost FROM (SELECT *, coalesce(sum(cost) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM priced) WHERE before < 0.05")
def budget_cutoff(spark, sf_dir):
    return metrics.within_budget(_calls(spark, sf_dir), "conv_id", "turn", 0.05).select("conv_id", "turn", F.round("cost", 6).alias("cost"))


#: Limits asked for, from conversations: none, too small, within the quota and past it, and of a model that isn't known.
WANTED = """SELECT CASE turn % 3 WHEN 0 THEN 'gpt-4.1' WHEN 1 THEN 'gpt-5.6-luna' ELSE 'none' END AS model, CASE WHEN conv_id % 4 = 0 THEN NULL ELSE CAST(length(text) * 5000 AS BIGINT) END AS tokens, CAST(conv_id % 3 * length(text) * 9 AS BIGINT) AS requests FROM conversations"""


@query(f"""WITH m(model, tl, rl) AS (VALUES {', '.join(f"('{m[0]}', {m[1]}, {m[2]})" for m in metrics.MODELS)}), w AS (SELECT model, tokens AS t, requests AS r FROM ({WANTED}))
SELECT model, CAST(CASE WHEN t IS NULL OR t < 1 THEN floor(tl * 0.5) WHEN tl IS NULL THEN t ELSE least(t, tl) END AS BIGINT) AS tokens, CAST(CASE WHEN r IS NULL OR r < 1 THEN floor(rl * 0.5) WHEN rl IS NULL THEN r ELSE least(r, rl) END AS BIGINT) AS requests, tl IS NOT NULL AS known FROM w LEFT JOIN m USING (model)""")
def model_limits(spark, sf_dir):
    return metrics.limits(derived(spark, sf_dir, WANTED), spark.createDataFrame(metrics.MODELS, metrics.MODEL_COLUMNS))


ROOM = "SELECT conv_id * 1000 + turn AS id, CAST(200 + length(text) AS INT) AS base FROM conversations"


@query(f"SELECT id, CAST(attempt AS INT) AS attempt, CAST(least(base * pow(2, attempt), 8000) AS BIGINT) AS max_tokens FROM ({ROOM}), range(10) r(attempt)")
def retry_ladder(spark, sf_dir):
    return metrics.retry_ladder(derived(spark, sf_dir, ROOM))


@query("SELECT event_type, min(value) AS min, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, max(value) AS max, avg(value) AS mean FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    return metrics.percentiles(read(spark, sf_dir, "events"), "event_type", "value")


@query("SELECT event_type, count(*) AS n, 'p' || p AS point, true AS near FROM events, (VALUES (50), (95), (99)) t(p) GROUP BY event_type, p")
def latency_sketches(spark, sf_dir):
    """Sketches by the hour merged by type: each quantile's rank in the values is within 2 % of its point."""
    e = read(spark, sf_dir, "events")
    hourly = metrics.sketches(e.withColumn("hour", F.date_trunc("hour", "ts")), ["event_type", "hour"], "value")
    told = metrics.sketched_percentiles(metrics.merged(hourly, ["event_type"]))
    each = told.select("event_type", "n", F.explode(F.create_map(*[x for p in ("p50", "p95", "p99") for x in (F.lit(p), F.col(p))])).alias("point", "q"))
    ranks = e.select("event_type", "value").join(F.broadcast(each), "event_type").groupBy("event_type", "n", "point", "q").agg(F.avg((F.col("value") <= F.col("q")).cast("double")).alias("high"), F.avg((F.col("value") < F.col("q")).cast("double")).alias("low"))
    p = F.substring("point", 2, 2).cast("double") / 100
    return ranks.select("event_type", "n", "point", ((F.col("low") <= p + 0.02) & (F.col("high") >= p - 0.02)).alias("near"))


@query("SELECT event_type, count(*) FILTER (value > 20) AS successes, count(*) FILTER (value <= 20) AS failures, count(*) FILTER (value > 20) / (epoch(max(ts) - min(ts))) AS per_second FROM events GROUP BY event_type")
def outcome_throughput(spark, sf_dir):
    wall = (F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / 1e6
    ok = F.count_if(F.col("value") > 20)
    return read(spark, sf_dir, "events").groupBy("event_type").agg(ok.alias("successes"), F.count_if(F.col("value") <= 20).alias("failures"), (ok / wall).alias("per_second"))


@query("SELECT event_type AS kind, round(sum(value), 4) AS seconds FROM events GROUP BY event_type UNION ALL SELECT 'total', round(sum(value), 4) FROM events")
def analysis_time(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    kept = rows.select(F.create_map(F.concat("event_type", F.lit("_analysis_time")), F.col("value").cast("string"), F.lit("pages"), F.lit("3")).alias("metrics"))
    return metrics.analysis_times(kept).select("kind", F.round("seconds", 4).alias("seconds"))


@query("SELECT doc_id, length(text) AS n_chars, CAST(len(string_split(text, ' ')) AS BIGINT) AS n_words FROM documents")
def text_volume(spark, sf_dir):
    return metrics.volume(read(spark, sf_dir, "documents"))


CPUS = "SELECT event_id AS id, CASE WHEN event_id % 5 > 0 THEN CAST(event_id % 120 - 7 AS INT) END AS asked, CAST(1 + user_id % 64 AS INT) AS cpus FROM events"


@query(f"SELECT id, greatest(1, least(coalesce(asked, least(32, cpus + 4)), least(32, cpus + 4))) AS workers FROM ({CPUS})")
def worker_counts(spark, sf_dir):
    return derived(spark, sf_dir, CPUS).select("id", metrics.worker_count(F.col("asked"), F.col("cpus")).alias("workers"))


NAMES = "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'gpt-5.6-' WHEN 1 THEN 'gpt-4.1' WHEN 2 THEN 'gpt-4o-mini' WHEN 3 THEN 'gpt-3.5' WHEN 4 THEN 'davinci' ELSE '' END || event_type AS m FROM events"


@query(f"SELECT event_id, m, CASE WHEN m LIKE 'gpt-5%' OR m LIKE 'gpt-4o%' THEN 'o200k_base' WHEN m LIKE 'gpt-4%' OR m LIKE 'gpt-3.5%' THEN 'cl100k_base' ELSE 'p50k_base' END AS encoding FROM ({NAMES})")
def token_encodings(spark, sf_dir):
    return derived(spark, sf_dir, NAMES).select("event_id", "m", metrics.encoding_of(F.col("m")).alias("encoding"))


KEYS = "SELECT event_id, event_type || upper(substr(event_type, 1, 1)) || substr(event_type, 2) || CASE event_id % 3 WHEN 0 THEN 'ID' WHEN 1 THEN 'Of' || user_id || 'X' ELSE '_asIs' END AS k FROM events"


@query(rf"SELECT event_id, k, lower(regexp_replace(k, '([a-z])([A-Z])', '\1_\2', 'g')) AS snake FROM ({KEYS})")
def snake_case_keys(spark, sf_dir):
    return derived(spark, sf_dir, KEYS).select("event_id", "k", snake_case(F.col("k")).alias("snake"))


@query("SELECT o_orderkey, epoch_us(CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END) AS us FROM orders")
def pdf_dates(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    written = F.when(F.col("o_orderkey") % 7 == 0, F.lit("D:2026")).otherwise(F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("+01'00'")))
    return o.select("o_orderkey", F.unix_micros(pdf_date(written)).alias("us"))


@query("SELECT conv_id, md5(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS chat_md5, count(*) AS n FROM conversations GROUP BY conv_id")
def chat_messages(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return rows.select("conv_id", F.md5(F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["role"], x["text"])), "\n")).alias("chat_md5"), F.size("m").cast("long").alias("n"))
