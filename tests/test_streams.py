"""Jobs as streams against what the whole of their events says, with late and repeated messages."""

import random

from pyspark.sql import functions as F

from inkveil.streaming import jobs

EVENT = "job_id string, ts timestamp, what string"


def outcomes(spark, batches, tmp_path, **options):
    """Each batch a file, and each file a batch of the stream."""
    for i, batch in enumerate(batches):
        rows = spark.createDataFrame([(j, float(s) + 1e6, w) for j, s, w in batch], "job_id string, s double, what string")
        rows.select("job_id", F.timestamp_seconds("s").alias("ts"), "what").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = jobs.run_available(jobs.deadlines(stream, **options), f"{tmp_path}/c", f"{tmp_path}/out")
    return sorted((r.job_id, r.outcome, r.seconds) for r in out.collect())


def test_late_and_repeated_messages_equal_the_batch(spark, tmp_path):
    rng = random.Random(1)
    events, want = [], []
    for i in range(40):
        start, took = 1000 + 60 * i, rng.choice((5, 120, 599, 601, 5000))
        events += [(f"j{i}", start, "start"), (f"j{i}", start + took, "end")]
        want.append((f"j{i}", "DONE" if took <= 600 else "TIMED_OUT", float(min(took, 600))))
    again = rng.sample(events, 30)  # the same message once more
    # messages come up to five minutes late, and so out of order
    order = sorted(events + again, key=lambda e: e[1] + rng.uniform(0, 300))
    batches = [order[i : i + 18] for i in range(0, len(order), 18)]
    assert outcomes(spark, batches, tmp_path, minutes=10, late="10 minutes") == sorted(want)


def test_timers_tell_of_jobs_without_an_end(spark, tmp_path):
    batches = [
        [("a", 0, "start"), ("b", 0, "end"), ("c", 100, "start")],
        [("tick", 2000, "start")],  # the deadlines of a and c pass
        [("c", 2100, "end"), ("a", 2100, "start"), ("tick", 2200, "end")],  # too late, and told already
        [("tock", 9000, "start")],  # the horizon passes: a's id is free again
        [("a", 9100, "start"), ("a", 9200, "end"), ("tock", 9300, "end")],
    ]
    want = [("a", "DONE", 100.0), ("a", "TIMED_OUT", 600.0), ("c", "TIMED_OUT", 600.0), ("tick", "DONE", 200.0), ("tock", "DONE", 300.0)]
    assert outcomes(spark, batches, tmp_path, minutes=10, late="1 second", horizon_minutes=60) == want


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    """The start in one run, the end in another."""
    def run(i, batch):
        spark.createDataFrame(batch, "job_id string, s long, what string").select("job_id", F.timestamp_seconds("s").alias("ts"), "what").write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        out = jobs.run_available(jobs.deadlines(stream, minutes=10), f"{tmp_path}/c", f"{tmp_path}/out{i}")
        return [(r.job_id, r.outcome) for r in out.collect()]

    assert run(0, [("a", 100, "start")]) == []
    assert run(1, [("a", 160, "end")]) == [("a", "DONE")]
    assert run(2, [("a", 170, "end"), ("a", 100, "start")]) == []


def test_deadlines_hold_in_any_time_zone(spark, tmp_path):
    """The watermark counts in UTC, and so do starts and ends."""
    held = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        batches = [[("a", 0, "start"), ("b", 10, "start")], [("b", 20, "end")], [("a", 400, "end")]]
        got = outcomes(spark, batches, tmp_path, minutes=10, late="10 minutes")
    finally:
        spark.conf.set("spark.sql.session.timeZone", held)
    assert got == [("a", "DONE", 400.0), ("b", "DONE", 10.0)]
