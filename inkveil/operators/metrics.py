"""Metrics: sums by key, costs and budgets, percentiles and throughput."""

from __future__ import annotations

import os
import threading
import time
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Models with their limits a minute and their cost for a million tokens.
MODELS = (("gpt-4.1", 1_000_000, 1000, 149, 593), ("gpt-5.6-luna", 3_000_000, 3000, 149, 593))
MODEL_COLUMNS = "model string, token_limit long, request_limit long, input_cost long, output_cost long"
#: Share of a model's quota that an instance takes by default.
SHARE = 0.5
#: Token encodings by the beginnings of model names, and that of all others.
ENCODINGS, OTHER_ENCODING = (("gpt-5", "o200k_base"), ("gpt-4o", "o200k_base"), ("gpt-4", "cl100k_base"), ("gpt-3.5", "cl100k_base")), "p50k_base"


def combined(rows: DataFrame, entries: str = "metrics") -> DataFrame:
    """(metric, total): the sum of each metric over maps of strings; what is no number does not
    count, nor does a metric without any number."""
    plain = rows.select(F.explode(F.map_entries(entries)).alias("e")).select(F.col("e.key").alias("metric"), F.expr("try_cast(e.value AS DOUBLE)").alias("value"))
    return plain.filter("value IS NOT NULL").groupBy("metric").agg(F.sum("value").alias("total"))


def with_count(sums: DataFrame, results: Column, name: str = "total_redaction_results") -> DataFrame:
    """Sums with the number of results, which a metric of that name overrides."""
    own = sums.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("metric", "total"))).alias("m"))
    return own.select(F.explode(F.map_concat(F.create_map(F.lit(name), results.cast("double")), "m")).alias("metric", "total"))


def priced(calls: DataFrame, models: DataFrame) -> DataFrame:
    """Calls (model, prompt_tokens, completion_tokens) with their cost; costs are for a million tokens."""
    cost = (F.col("prompt_tokens") * F.col("input_cost") + F.col("completion_tokens") * F.col("output_cost")) / 1e6
    return calls.join(models, "model").withColumn("cost", cost)


def within_budget(calls: DataFrame, key: str, order: str, budget: float) -> DataFrame:
    """The calls made before the cost so far reached the budget: the one that reaches it is the last."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return calls.withColumn("before", F.coalesce(F.sum("cost").over(w), F.lit(0.0))).filter(F.col("before") < budget).drop("before")


def limits(wanted: DataFrame, models: DataFrame) -> DataFrame:
    """Requested limits (model, tokens, requests) against the models': half the quota where none
    or less than one is asked for, the quota at most. Unknown models have a null `known`."""
    joined = wanted.join(models, "model", "left")
    one = lambda asked, quota: F.when(F.col(asked).isNull() | (F.col(asked) < 1), F.floor(F.col(quota) * SHARE)).otherwise(F.least(asked, quota)).cast("long")
    return joined.select("model", one("tokens", "token_limit").alias("tokens"), one("requests", "request_limit").alias("requests"), F.col("token_limit").isNotNull().alias("known"))


def retry_ladder(rows: DataFrame, attempts: int = 10, most: int = 8000) -> DataFrame:
    """(id, attempt, max_tokens): the room for a reply, doubled after each cut-off, `most` at most."""
    return rows.select("id", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))).alias("attempt"), "base").select("id", "attempt", F.least(F.col("base") * F.pow(F.lit(2), "attempt"), F.lit(most)).cast("long").alias("max_tokens"))


def percentiles(rows: DataFrame, key: str, value: str) -> DataFrame:
    """min, p50, p95, p99, max and mean by key, linear between values."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return rows.groupBy(key).agg(F.min(value).alias("min"), p.alias("p"), F.max(value).alias("max"), F.avg(value).alias("mean")).select(key, "min", *[F.col("p")[i].alias(n) for i, n in enumerate(("p50", "p95", "p99"))], "max", "mean")


def sketches(rows: DataFrame, keys: list[str], value: str, k: int = 400) -> DataFrame:
    """(keys, n, sketch): of each group a KLL sketch of its values, of a size that k bounds. A quantile's
    rank is off by about 2.3 / k ** 0.9 at most (1 % with 400), with 99 % certainty."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))


def merged(held: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of finer groups as those of coarser ones, without the values."""
    return held.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_percentiles(held: DataFrame, points: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """The sketches' rows with a column p50, p95... for each point; the exact form is `percentiles`,
    which holds all distinct values of a key in one task."""
    named = {f"p{round(100 * p)}": F.kll_sketch_get_quantile_double("sketch", F.lit(p)) for p in points}
    return held.withColumns(named).drop("sketch")


def worker_count(asked: Column, cpus: Column) -> Column:
    """Between 1 and the lesser of 32 and the processors plus 4."""
    most = F.least(F.lit(32), cpus + 4)
    return F.greatest(F.lit(1), F.least(F.coalesce(asked, most), most))


def encoding_of(model: Column) -> Column:
    out = F.lit(OTHER_ENCODING)
    for prefix, name in reversed(ENCODINGS):
        out = F.when(model.startswith(prefix), name).otherwise(out)
    return out


def volume(docs: DataFrame) -> DataFrame:
    """Characters and approximate words (pieces between single spaces) of each document."""
    return docs.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.size(F.split("text", " ")).cast("long").alias("n_words"))


def analysis_times(rows: DataFrame, entries: str = "metrics") -> DataFrame:
    """(kind, seconds): the sums of the metrics whose name has "analysis_time", by what stands
    before it in the name, and of all of them as the kind total."""
    sums = combined(rows, entries).filter(F.col("metric").contains("analysis_time"))
    return sums.rollup(F.regexp_extract("metric", "^(.*?)_?analysis_time", 1).alias("kind")).agg(F.sum("total").alias("seconds")).select(F.coalesce("kind", F.lit("total")).alias("kind"), "seconds")


@contextmanager
def wall_time(into: dict[str, float], name: str):
    """Put the seconds that a block takes into a dictionary, whether it fails or not."""
    began = time.monotonic()
    try:
        yield
    finally:
        into[name] = time.monotonic() - began


class MemorySnapshots:
    """The process's resident memory in MB, taken every so many seconds until the block ends."""

    def __init__(self, every: float = 30.0):
        self.every, self.taken, self._end = every, [], threading.Event()

    def _now(self) -> float:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6

    def _run(self) -> None:
        while not self._end.wait(self.every):
            self.taken.append(self._now())

    def __enter__(self) -> MemorySnapshots:
        self.taken.append(self._now())
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._end.set()
        self._thread.join()
        self.taken.append(self._now())
