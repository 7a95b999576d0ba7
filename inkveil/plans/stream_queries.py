"""Queries that run as streams over files, to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..streaming import jobs
from .base import query


def _events(spark, sf_dir):
    # a pattern may name a file as well as a folder of files, which a plain path of a stream may not
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _messages(spark, sf_dir):
    body = F.to_json(F.struct(F.when(F.col("event_id") % 10 > 0, F.col("user_id").cast("string")).alias("job_id"), F.col("event_type").alias("stage")))
    return _events(spark, sf_dir).select("ts", body.alias("value"))


def _collected(spark, stream, mode="append"):
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not folder:
        import tempfile

        folder = tempfile.mkdtemp(prefix="streams-")
    name = f"stream_{uuid.uuid4().hex}"
    return jobs.run_available(stream, f"{folder}/{name}/state", f"{folder}/{name}/rows", mode)


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS job_id FROM events WHERE event_id % 10 > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts) = 1")
def stream_first_requests(spark, sf_dir):
    """Each id's first request; the events span less than the horizon, so that it is one an id."""
    good, _ = jobs.requests(_messages(spark, sf_dir))
    return _collected(spark, jobs.first_requests(good, horizon="3650 days").select("job_id"))


@query("SELECT count(*) AS n FROM events WHERE event_id % 10 = 0")
def stream_dead_letters(spark, sf_dir):
    _, bad = jobs.requests(_messages(spark, sf_dir))
    return _collected(spark, bad).agg(F.count("*").alias("n"))


@query("SELECT event_type AS stage, date_trunc('hour', ts) AS start, count(*) AS n FROM events WHERE event_id % 10 > 0 GROUP BY ALL")
def stream_stage_counts(spark, sf_dir):
    good, _ = jobs.requests(_messages(spark, sf_dir))
    return _collected(spark, jobs.stage_counts(good), "complete").select("stage", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT CAST(event_id AS VARCHAR) AS job_id, CASE WHEN floor(value * 30) <= 600 THEN 'DONE' ELSE 'TIMED_OUT' END AS outcome, least(floor(value * 30), 600)::DOUBLE AS seconds FROM events")
def stream_deadlines(spark, sf_dir):
    """Jobs of two events each, start and end; those over ten minutes time out."""
    e = _events(spark, sf_dir)
    start = e.select(F.col("event_id").cast("string").alias("job_id"), "ts", F.lit("start").alias("what"))
    end = e.select(F.col("event_id").cast("string").alias("job_id"), F.timestamp_micros(F.unix_micros("ts") + F.floor(F.col("value") * 30).cast("long") * 1000000).alias("ts"), F.lit("end").alias("what"))
    return _collected(spark, jobs.deadlines(start.unionByName(end), minutes=10))
