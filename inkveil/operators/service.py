"""Calls of an outside service from many tasks: scheduled under one quota, paced, repeated, budgeted, asked once."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settle

#: Room for a reply that was cut short is doubled, up to this.
MOST_REPLY = 8000


class CutShort(Exception):
    """The reply was cut short for want of room."""


class OutOfPatience(TimeoutError):
    """A call would have waited longer than its rule allows."""


def schedule(requests: DataFrame, parts: int, tokens: float | None = None, calls: float | None = None, by: Column | None = None) -> DataFrame:
    """When each request (id, weight) may be made: (id, weight, part, start_s), start_s in seconds from
    the job's begin, so that in no minute all parts together take more than `tokens` or `calls`.

    Requests are dealt to `parts` by a hash of the id, or `by` a number from 0. A part's share of
    the quota is its share of all requests' cost, dealt ahead, so that parts need not know of
    each other and end together. A request costs the greater of its weight over the tokens and
    of one over the calls, both less what each part may go past its share, its last request: a
    minute of a part begins less than its share before the last one. One request that is
    heavier than tokens / parts leaves no room: that fails. Without a quota all start at 0.

    What is gathered is a row a part; the sum runs within each part.
    """
    part = F.pmod(F.xxhash64("id"), F.lit(parts)) if by is None else by
    dealt = requests.select("id", F.col("weight").cast("double").alias("weight"), part.cast("int").alias("part"))
    if calls is not None and calls <= parts:
        raise ValueError("there are to be more calls a minute than parts")
    heaviest = dealt.agg(F.coalesce(F.max("weight"), F.lit(0.0)).alias("w")).scalar()
    room = F.lit(float(tokens or 0)) - parts * heaviest
    fits = F.when(room > 0, room).otherwise(F.raise_error(F.lit("a request is too heavy for the parts' shares: take fewer parts")).cast("double"))
    per = [F.lit(1.0) / (calls - parts)] if calls is not None else []
    per += [F.col("weight") / fits] if tokens is not None else []
    cost = F.greatest(*per, F.lit(0.0)) if per else F.lit(0.0)
    costed = dealt.withColumn("cost", cost)
    shares = costed.groupBy("part").agg(F.sum("cost").alias("of_part"))
    total = shares.agg(F.sum("of_part").alias("t")).scalar()
    before = F.coalesce(F.sum("cost").over(Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    timed = costed.withColumn("before", before).join(F.broadcast(shares), "part")  # a row a part
    start = F.when(F.col("of_part") > 0, 60 * F.col("before") * total / F.col("of_part")).otherwise(0.0)
    return timed.select("id", "weight", "part", start.alias("start_s"))


class Pace:
    """Waits until a request's place in the schedule, counted from this task's first one."""

    def __init__(self, patience: float | None = None, clock=time.monotonic, sleep=time.sleep):
        self.patience, self.clock, self.sleep, self.zero = patience, clock, sleep, None

    def wait(self, start_s: float) -> None:
        now = self.clock()
        self.zero = now - start_s if self.zero is None else self.zero
        left = self.zero + start_s - now
        if self.patience is not None and left > self.patience:
            raise OutOfPatience(f"{left:.0f} seconds are more than {self.patience:.0f}")
        if left > 0:
            self.sleep(left)


def with_retries(call: Callable, attempts: int = 10, wait: float = 1.0, most: float = 60.0, reply: int | None = None, sleep=time.sleep) -> Callable:
    """A call that is made again after errors, waiting twice as long each time; the last error is
    raised. With `reply`, the room for a reply is the call's second argument, and a reply that
    was cut short is asked for again at once with twice the room, MOST_REPLY at most."""

    def run(text: str):
        room = reply
        for k in range(attempts):
            try:
                return call(text) if room is None else call(text, room)
            except CutShort:
                if room is None or room >= MOST_REPLY or k == attempts - 1:
                    raise
                room = min(MOST_REPLY, 2 * room)
            except Exception:
                if k == attempts - 1:
                    raise
                sleep(min(most, wait * 2**k))
        return []

    return run


ANSWERS = "id string, terms array<string>, prompt_tokens long, completion_tokens long, error string"
ANSWER_TYPES = (pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string())
#: Requests whose texts are held at once.
TOGETHER = 64
#: What a request that the budget left no room for says.
SPENT = "budget spent"


def ask(requests: DataFrame, rule: dict) -> DataFrame:
    """The service's answers to requests (id, text), each asked once: (id, terms, prompt_tokens,
    completion_tokens, error). The answers are settled, so that whoever reads them, and however
    often, sees the same and no call is made again.

    The rule has `call`, which maps a text (and the room for the reply, if the rule has `reply`)
    to (terms, prompt_tokens, completion_tokens). `partitions` calls are made at once; `capacity`
    is the words and `per_minute` the calls in a minute of all of them together; `patience` how
    many seconds a call may wait for its place; `attempts` how often a failed call is made.
    `budget`, with `prices` (input, output for a million tokens), is dealt to the partitions by
    their requests' words: the call that reaches a partition's part is its last one. A call that
    fails, and one that isn't made, is a row with its error and without terms; the job goes on.
    """
    parts = rule.get("partitions", 1 if {"budget", "capacity", "per_minute"} & {*rule} else None)
    call = with_retries(rule["call"], rule.get("attempts", 1), reply=rule.get("reply"))
    budget, prices, patience = rule.get("budget"), rule.get("prices", (0.0, 0.0)), rule.get("patience")
    weight = (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1).alias("weight")
    if parts is None:
        timed = requests.select("id", "text", F.lit(0.0).alias("start_s"), F.lit(None).cast("double").alias("purse"))
    else:
        places = schedule(requests.select("id", weight), parts, rule.get("capacity"), rule.get("per_minute"))
        spend = places.groupBy("part").agg(F.sum("weight").alias("own"))
        spend = spend.select("part", (F.col("own") / spend.agg(F.sum("own").alias("all")).scalar() * (budget or 0.0)).alias("purse"))
        timed = places.join(F.broadcast(spend), "part").join(requests, "id").repartition(parts, "part").sortWithinPartitions("part", "start_s", "id").select("id", "text", "start_s", "purse", "part")

    def run(batches: Iterable[pa.RecordBatch]):
        paces, spent = {}, {}
        for batch in batches:
            for low in range(0, batch.num_rows, TOGETHER):
                asked_now = batch.slice(low, TOGETHER).to_pydict()
                out = []
                part_of = asked_now.get("part", [0] * len(asked_now["id"]))
                for name, text, start_s, purse, part in zip(asked_now["id"], asked_now["text"], asked_now["start_s"], asked_now["purse"], part_of, strict=True):
                    if budget is not None and spent.get(part, 0.0) >= purse:
                        out.append((name, [], 0, 0, SPENT))
                        continue
                    try:
                        paces.setdefault(part, Pace(patience)).wait(start_s)
                        terms, asked, answered = call(text)
                        spent[part] = spent.get(part, 0.0) + (asked * prices[0] + answered * prices[1]) / 1e6
                        out.append((name, list(dict.fromkeys(terms)), asked, answered, None))
                    except Exception as e:  # the service's fault is data here
                        out.append((name, [], 0, 0, f"{type(e).__name__}: {e}"))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), ANSWER_TYPES, strict=True)], names=["id", "terms", "prompt_tokens", "completion_tokens", "error"])

    return settle(timed.mapInArrow(run, ANSWERS))
