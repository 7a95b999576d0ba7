"""Queries through listings, the queue, artefacts, and calls under a quota."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import jobs, service
from ..sources import artefacts, connectors, queue
from ..sources.shared import shared_dir
from .base import query, read
from .stream_queries import _events


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT DISTINCT 'en=' || (lang = 'en') || '/source=' || source AS folder FROM documents WHERE lang = 'en' AND source LIKE 'src1%'")
def stored_folders(spark, sf_dir):
    """Documents stored by language and source, and of the listing the folders that a prefix leaves."""
    docs = read(spark, sf_dir, "documents").select("doc_id", (F.col("lang") == "en").alias("en"), "source", F.col("text"))
    store = connectors.connector("file", spark, _folder(spark, "store"))
    store.write(docs.repartition("source"), "documents", by=("en", "source"))
    found = store.listing("documents/en=true/source=src1")
    return found.select(F.regexp_replace("folder", "^documents/", "").alias("folder")).distinct()


@query("SELECT name, created FROM (SELECT 'job' || user_id || '-' || (event_id % 9) || '/' || event_type || '/proposed_redactions.json' AS name, ts AS created FROM events) WHERE starts_with(name, 'job1')")
def blobs_by_prefix(spark, sf_dir):
    """Blobs that events name, as a table (`stored_folders` lists real ones)."""
    e = read(spark, sf_dir, "events")
    name = F.concat(F.lit("job"), F.col("user_id").cast("string"), F.lit("-"), (F.col("event_id") % 9).cast("string"), F.lit("/"), "event_type", F.lit("/proposed_redactions.json"))
    return e.select(name.alias("name"), F.col("ts").alias("created")).filter(F.col("name").startswith("job1"))


def _requests(events):
    """Messages of events: every other one brings its id."""
    own = F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string"))
    return events.select(F.to_json(F.struct(own.alias("overrideId"), F.col("event_type").alias("fileKind"))).alias("body"), "ts")


@query("""SELECT CASE WHEN event_id % 2 = 0 THEN event_id::VARCHAR ELSE sha256('{"fileKind":"' || event_type || '"}|' || epoch_us(ts)) END AS id, event_type AS file_kind, ts + INTERVAL 1 DAY AS expires FROM events""")
def queue_round_trip(spark, sf_dir):
    """Events as a stream into the queue, and out of it again in batches of a bounded number of messages."""
    queue.register(spark)
    folder = _folder(spark, "queue")
    messages = jobs.queue_messages(_requests(_events(spark, sf_dir)), F.lit("ANALYSE"))
    messages.writeStream.format("queue").option("path", f"{folder}/q").option("checkpointLocation", f"{folder}/in").trigger(availableNow=True).start().awaitTermination()
    limit, got = max(1000, spark.read.parquet(f"{sf_dir}/events.parquet").count() // 3), []

    def put(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        got.append(number)

    more = -1
    while len(got) > more:  # until there is nothing left: each start takes a batch
        more = len(got)
        stream = spark.readStream.format("queue").option("path", f"{folder}/q").option("reader", "r").option("limit", limit).load()
        stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(f"{queue.COLUMNS}, batch int").parquet(f"{folder}/rows") if got else spark.createDataFrame([], queue.COLUMNS)
    return rows.select("id", F.get_json_object("value", "$.fileKind").alias("file_kind"), F.col("expires").cast("timestamp_ntz").alias("expires"))


@query("SELECT doc_id, length(text) AS n_chars FROM documents WHERE text IS NOT NULL")
def stage_artefacts(spark, sf_dir):
    """A stage's artefacts after a second run of it that ended before its commit."""
    docs = read(spark, sf_dir, "documents").filter("text IS NOT NULL")
    held = artefacts.Artefacts(spark, _folder(spark, "jobs"), "job-1")
    held.save("ANALYSE", raw=docs.select("doc_id", "text"), proposed=docs.select("doc_id"))
    held.stage("ANALYSE", raw=docs.select("doc_id", F.lit("half").alias("text")))
    return held.read("ANALYSE", "raw").join(held.read("ANALYSE", "proposed"), "doc_id").select("doc_id", F.length("text").cast("long").alias("n_chars"))


TOKENS_A_MINUTE, CALLS_A_MINUTE, CALLERS = 20_000, 120, 4
SCHEDULE = f"""requests AS (SELECT conv_id * 1000 + turn AS id, (conv_id % {CALLERS})::INT AS part, len(string_split(text, ' '))::DOUBLE AS weight FROM conversations),
costed AS (SELECT *, greatest(1.0::DOUBLE / ({CALLS_A_MINUTE} - {CALLERS}), weight / ({TOKENS_A_MINUTE} - {CALLERS} * (SELECT max(weight) FROM requests))) AS cost FROM requests),
summed AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY part ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(cost) OVER (PARTITION BY part) AS of_part, sum(cost) OVER () AS total FROM costed),
timed AS (SELECT id, part, weight, 60 * before * total / of_part AS start_s FROM summed)"""


def _schedule(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    requests = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.size(F.split("text", " ")).alias("weight"))
    return service.schedule(requests, CALLERS, TOKENS_A_MINUTE, CALLS_A_MINUTE, by=F.floor(F.col("id") / 1000) % CALLERS)


@query(f"WITH {SCHEDULE} SELECT id, part, weight, round(start_s, 4) AS start_s FROM timed")
def call_schedule(spark, sf_dir):
    """When each turn of the conversations may be sent to a service, under one quota for all callers."""
    return _schedule(spark, sf_dir).select("id", "part", "weight", F.round("start_s", 4).alias("start_s"))


@query(f"""WITH {SCHEDULE} SELECT floor((start_s + 1e-6) / 60)::BIGINT AS minute, count(*) AS n_calls, sum(weight) AS tokens, sum(weight) <= {TOKENS_A_MINUTE} AND count(*) <= {CALLS_A_MINUTE} AS within FROM timed GROUP BY 1""")
def calls_by_minute(spark, sf_dir):
    minute = F.floor((F.col("start_s") + 1e-6) / 60)
    rows = _schedule(spark, sf_dir).groupBy(minute.alias("minute")).agg(F.count("*").alias("n_calls"), F.sum("weight").alias("tokens"))
    return rows.withColumn("within", (F.col("tokens") <= TOKENS_A_MINUTE) & (F.col("n_calls") <= CALLS_A_MINUTE))
