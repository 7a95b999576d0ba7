"""The control plane as streams: requests, one job an id, deadlines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

REQUEST = "job_id string, stage string, timeout_minutes double"


def requests(messages: DataFrame, body: str = "value", at: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(good, bad): messages with a job_id as columns, and those without as they came."""
    parsed = messages.withColumn("r", F.from_json(body, REQUEST))
    good = parsed.filter(F.col("r.job_id").isNotNull()).select(at, "r.*")
    return good, parsed.filter(F.col("r.job_id").isNull()).select(at, body)


def first_requests(stream: DataFrame, at: str = "ts", horizon: str = "1 day") -> DataFrame:
    """One request an id within the horizon, which is also when messages expire."""
    return stream.withWatermark(at, horizon).dropDuplicatesWithinWatermark(["job_id"])


def stage_counts(stream: DataFrame, at: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests by stage and window of event time, final once the watermark has passed."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), "stage").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "stage", "n")


LIVES = pa.schema([("job_id", pa.string()), ("started", pa.int64()), ("ended", pa.int64()), ("told", pa.bool_()), ("due", pa.int64())])


class Orchestration(StatefulProcessor):
    """Jobs' lives: start, end and deadline, told once, forgotten after the horizon.

    The key is a bucket of jobs, and its state their lives as one Arrow table, as a job that
    were a key by itself would cost calls of several milliseconds to the state store. A life is when the job
    started and ended, as far as it is known, whether it was told, and when it is due. Of
    repeated starts and ends the earliest count, in whatever order they come. Due is, in event
    time, first the deadline and then, once the job was told, the horizon; until then
    messages that come again change nothing. The bucket's timer is the first that is due.
    """

    def __init__(self, limit: int, horizon: int):
        self.limit, self.horizon = limit, horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("jobs", "lives binary")

    def _lives(self) -> dict:
        if not self.held.exists():
            return {}
        ids, *rest = (c.to_pylist() for c in pa.ipc.open_stream(self.held.get()[0]).read_all().columns)
        return dict(zip(ids, zip(*rest, strict=True), strict=True))

    def _met(self, life: tuple | None, start: int | None, end: int | None, now: int) -> tuple[tuple, tuple | None]:
        """A life after a start and an end that came, and its outcome if there is one now."""
        started, ended, told, _ = life or (None, None, False, None)
        known = ended if started is None else started
        if (told or started is None) and known is not None and now >= known + self.horizon:
            started, ended, told = None, None, False  # input comes before timers that are due
        first = lambda a, b: b if a is None else a if b is None else min(a, b)
        started, ended, out = first(started, start), first(ended, end), None
        if not told and started is not None and ended is not None and ended >= started:
            told, took = True, ended - started
            out = ("DONE" if took <= self.limit else "TIMED_OUT", min(took, self.limit) / 1000)
        known = ended if started is None else started
        return (started, ended, told, max(known + (self.limit if started is not None and not told else self.horizon), now + 1)), out

    def _settled(self, lives: dict, out: list, timers) -> Iterator[pd.DataFrame]:
        """What is due is told or forgotten, the lives are held and the timer set."""
        now = timers.getCurrentWatermarkInMs()
        for job, (started, ended, told, due) in [x for x in lives.items() if x[1][3] <= now]:
            if told or started is None:  # the horizon
                del lives[job]
            else:
                lives[job] = (started, ended, True, max(started + self.horizon, now + 1))
                out.append((job, "TIMED_OUT", self.limit / 1000))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if lives:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, LIVES) as stream:
                stream.write_table(pa.table([list(lives), *zip(*lives.values(), strict=True)], schema=LIVES))
            self.held.update((sink.getvalue().to_pybytes(),))
            self.handle.registerTimer(min(due for *_, due in lives.values()))
        else:
            self.held.clear()
        if out:
            yield pd.DataFrame(out, columns=["job_id", "outcome", "seconds"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came: dict = {}
        for pdf in rows:
            for job, at, what in zip(pdf["job_id"].tolist(), pdf["at"].tolist(), pdf["what"].tolist(), strict=True):
                ends = came.setdefault(job, [None, None])
                k = int(what == "end")
                if ends[k] is None or at < ends[k]:
                    ends[k] = at
        lives, out, now = self._lives(), [], timerValues.getCurrentWatermarkInMs()
        for job, (start, end) in came.items():
            lives[job], outcome = self._met(lives.get(job), start, end, now)
            if outcome:
                out.append((job, *outcome))
        yield from self._settled(lives, out, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settled(self._lives(), [], timerValues)

    def close(self) -> None:
        pass


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def deadlines(events: DataFrame, minutes: float = 180.0, late: str = "10 minutes", horizon_minutes: float = 1440.0, buckets: int = 512) -> DataFrame:
    """Events (job_id, ts, what: "start" or "end") to (job_id, outcome, seconds), once a job.

    An end in time gives DONE, and the deadline, or an end after it, TIMED_OUT. Events may come
    up to `late` after later ones, in any order and again; a job is forgotten, and its id free,
    when the horizon has passed in event time. Jobs whose start is unknown give nothing. The
    session's state store is set to RocksDB, which timers need.

    Jobs are dealt into `buckets` by their id, each of which is held at a time and written anew by
    a batch that touches it; a checkpoint is bound to its number.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    life = Orchestration(int(minutes * 60_000), int(horizon_minutes * 60_000))
    # milliseconds since the epoch, as the watermark counts, whatever the session's time zone
    kept = events.filter("what IN ('start', 'end') AND ts IS NOT NULL").select("job_id", "ts", F.unix_millis("ts").alias("at"), "what", F.pmod(F.xxhash64("job_id"), F.lit(buckets)).alias("bucket"))
    keyed = kept.withWatermark("ts", late).groupBy("bucket")
    return keyed.transformWithStateInPandas(life, "job_id string, outcome string, seconds double", "Append", "eventTime")


def run_available(stream: DataFrame, checkpoint: str, path: str, mode: str = "append") -> DataFrame:
    """Process all that is there and end, into Parquet at `path`, which is returned to be read. A
    batch that is run again replaces what it wrote; in complete mode each replaces all."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={0 if mode == 'complete' else number}")

    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/batch=-1")
    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).drop("batch")


def file_queue(spark, path: str, schema: str, files: int = 16) -> DataFrame:
    """A folder of message files as a stream of at most so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def to_topics(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Responses (service, ...) as JSON lines in a folder for each topic's subject; those
    without a service go nowhere. A batch that is run again replaces what it wrote."""
    from ..functions.text import service_label

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.filter("service IS NOT NULL").withColumn("subject", service_label(F.col("service")))
        body = rows.select("subject", F.to_json(F.struct(*[c for c in rows.columns if c != "subject"])).alias("value"))
        body.write.mode("overwrite").partitionBy("subject").text(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
