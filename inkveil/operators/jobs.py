"""Jobs: payloads, outcomes, versions, deadlines, messages and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_job_id, service_label

STAGES = {"redact": "ANALYSE", "apply": "REDACT", "sanitise": "SANITISE"}
SERVICES = ("ALPHA", "BETA_SERVICE")
LONGEST_ID = 60
TIMEOUT_MINUTES = 180
#: For each container the tier of its blobs from an age in days on.
RETENTION = {"redactiondata": ((7, "DELETE"), (0, "HOT")), "analytics": ((60, "ARCHIVE"), (30, "COLD"), (0, "HOT")), "test": ((1, "DELETE"), (0, "HOT"))}
REQUEST = "job_id string, configName string, fileKind string, service string, skipRedaction boolean, overrideId string, timeoutMinutes double, readDetails struct<storageKind:string,teamEmail:string,properties:map<string,string>>, writeDetails struct<storageKind:string,teamEmail:string,properties:map<string,string>>"


def stage_of(route: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv])[route]


def payload_errors(body: Column) -> Column:
    """What is wrong with a request's JSON, as an array: empty for a valid one. Unknown keys are ignored."""
    p = F.from_json(body, REQUEST)
    check = lambda bad, word: F.when(bad, F.lit(word))
    parts = []
    for part in ("readDetails", "writeDetails"):
        given = p[part].isNotNull()
        parts += [check(given & p[part][k].isNull(), f"{part}.{k} is missing") for k in ("storageKind", "properties")]
    return F.array_compact(F.array(
        check(F.try_parse_json(body).isNull(), "not JSON"),
        check(p["fileKind"].isNull(), "fileKind is missing"),
        check(p["service"].isNotNull() & ~p["service"].isin(*SERVICES), "service is unknown"),
        *parts,
    ))


def job_folder(job_id: Column) -> Column:
    """The job's folder; ids that are null or too long have none."""
    return F.when(F.length(job_id) <= LONGEST_ID, clean_job_id(job_id))


def latest(blobs: DataFrame, suffix: str) -> DataFrame:
    """(folder, name): of a folder's blobs (folder, name, created) with the suffix the newest."""
    return blobs.filter(F.col("name").endswith(suffix)).groupBy("folder").agg(F.max_by("name", F.struct("created", "name")).alias("name"))


def proposal_before(jobs: DataFrame, blobs: DataFrame) -> DataFrame:
    """As-of look-back: for jobs (base, version) the newest blob (base, version, name, created)
    of the greatest version that is two less at most; jobs below version 3 have none. One
    pass over a base's versions in order, a look-back over those that far behind."""
    best = blobs.filter("version >= 1").groupBy("base", "version").agg(F.max_by("name", F.struct("created", "name")).alias("name"))
    held = best.withColumn("asks", F.lit(False)).unionByName(jobs.filter("version > 2").select("base", "version", F.lit(None).cast("string").alias("name"), F.lit(True).alias("asks")).distinct())
    w = Window.partitionBy("base").orderBy("version").rangeBetween(Window.unboundedPreceding, -2)
    seen = F.last(F.when(~F.col("asks"), F.struct("name", "version")), ignorenulls=True).over(w)
    return held.withColumn("seen", seen).filter("asks AND seen IS NOT NULL").select("base", "version", "seen.name", F.col("seen.version").alias("from_version"))


def unique_id(job_id: Column, seconds: Column | None = None) -> Column:
    """A job's id with the time in whole seconds, so that a second run of it is told apart."""
    return F.concat(job_id, F.lit("-"), (seconds if seconds is not None else F.unix_timestamp()).cast("long"))


def today() -> Column:
    """The date in UTC as ISO text."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd")


def queue_messages(requests: DataFrame, stage: Column, at: str = "ts", days: int = 1) -> DataFrame:
    """Requests (body JSON, time) as messages for the queue: (id, expires, value). The id is the
    body's overrideId, or a hash of the body and the time, so that a message that is sent again
    has the same; the body gains the job_id and the stage."""
    parsed = requests.withColumn("p", F.from_json("body", "map<string,string>"))
    named = parsed.withColumn("id", F.coalesce(F.col("p")["overrideId"], F.sha2(F.concat_ws("|", "body", F.unix_micros(F.col(at).cast("timestamp")).cast("string")), 256))).filter("p IS NOT NULL")
    value = F.to_json(F.map_concat(F.map_filter("p", lambda k, _: ~k.isin("job_id", "stage")), F.create_map(F.lit("job_id"), F.col("id"), F.lit("stage"), stage)))
    return named.select("id", (F.col(at) + F.make_dt_interval(days=F.lit(days))).alias("expires"), value.alias("value"))


def timed(jobs: DataFrame, default: float = TIMEOUT_MINUTES) -> DataFrame:
    """Jobs (job_id, started, ended, timeout_minutes) with their deadline and whether they met it."""
    limit = F.coalesce("timeout_minutes", F.lit(float(default)))
    deadline = F.timestamp_seconds(F.unix_micros("started") / 1e6 + limit * 60)
    return jobs.withColumn("deadline", deadline).withColumn("outcome", F.when(F.col("ended").isNotNull() & (F.col("ended") <= deadline), "DONE").otherwise("TIMED_OUT"))


def failure_notices(jobs: DataFrame) -> DataFrame:
    """A notice for each job that timed out and names a service."""
    late = jobs.filter("outcome = 'TIMED_OUT' AND service IS NOT NULL")
    return late.select(F.col("job_id").alias("id"), F.coalesce("stage", F.lit("UNKNOWN")).alias("stage"), F.lit("FAIL").alias("status"), service_label(F.col("service")).alias("subject"), F.concat(F.lit("Job "), "job_id", F.lit(" timed out")).alias("message"))


def first_requests(requests: DataFrame, order: str = "ts") -> DataFrame:
    """One orchestration an id: the first request of each."""
    w = Window.partitionBy("job_id").orderBy(order)
    return requests.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def alive(messages: DataFrame, now: Column, days: int = 1) -> DataFrame:
    """Messages (ts) that have not expired."""
    return messages.filter(F.col("ts") > now - F.make_dt_interval(days=F.lit(days)))


def retention(container: Column, age_days: Column) -> Column:
    """HOT, COLD, ARCHIVE or DELETE by container and age; other containers stay HOT."""
    out = F.lit("HOT")
    for name, steps in RETENTION.items():
        tier = F.coalesce(*[F.when(age_days >= days, F.lit(t)) for days, t in steps], F.lit("HOT"))
        out = F.when(container == name, tier).otherwise(out)
    return out


def responses(jobs: DataFrame) -> DataFrame:
    """Jobs (job_id, stage, error, and warnings of the steps after) as their final message: the
    outcome, and the warnings in their fixed order on lines of their own."""
    steps = F.array_compact(F.array("bus_warning", "metrics_warning", "exception_warning", "log_warning"))
    lines, some = F.array_join(steps, "\n"), F.size(steps) > 0
    failed = F.concat(F.lit("Redaction process failed with the following error: "), "error")
    message = (
        F.when(F.col("error").isNotNull() & some, F.concat(failed, F.lit("\nAdditionally, the following non-fatal errors occurred:\n"), lines))
        .when(F.col("error").isNotNull(), failed)
        .when(some, F.concat(F.lit("Redaction process completed successfully, but had some non-fatal errors:\n"), lines))
        .otherwise(F.lit("Redaction process complete"))
    )
    return jobs.select("job_id", "stage", F.when(F.col("error").isNotNull(), "FAIL").otherwise("SUCCESS").alias("status"), message.alias("message"))


def is_service_fault(code: Column) -> Column:
    return (code >= 500) | code.isin(408, 429)


def is_app_failure(body: Column) -> Column:
    """Whether a job's status JSON tells of a failure of the application."""
    get = lambda path: F.get_json_object(body, path)
    return F.coalesce(get("$.runtimeStatus").isin("Failed", "Terminated"), F.lit(False)) | F.coalesce(F.length(get("$.errorMessage")) > 0, F.lit(False)) | F.coalesce(get("$.output.status") == "FAIL", F.lit(False))


def exception_log(errors: DataFrame) -> DataFrame:
    """(job_id, log): a job's exceptions (job_id, seq, message) in order, two empty lines between."""
    return errors.groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "message"))), lambda e: e["message"]), "\n\n\n").alias("log"))
