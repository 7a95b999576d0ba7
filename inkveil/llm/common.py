"""What the operators share: settled intermediates, the number of parts, and hashes of tokens."""

from __future__ import annotations

import ctypes
import tempfile
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, set from spark.checkpoint.dir. Where that is unset,
    a folder of this machine serves a local session, as in tests; on a cluster it is an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


#: Drops the shuffles of a query as soon as it has ended.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame) -> DataFrame:
    """Compute df once into the shared checkpoint folder and cut its lineage there. Its shuffles
    go at once: what is settled is never computed again, and theirs and the next ones' would add up."""
    spark = df.sparkSession
    shared_dir(spark)
    held = spark.conf.get(CLEANED, "false")
    spark.conf.set(CLEANED, "true")
    try:
        return df.select("*").checkpoint()  # a plan of its own, made under the setting
    finally:
        spark.conf.set(CLEANED, held)


def partitions(spark: SparkSession, least: int = 1) -> int:
    """How many parts a keyed shuffle gets: the session's own figure, `least` at least."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def parts_of(df: DataFrame, least: int = 1, times: int = 2) -> int:
    """How many parts a shuffle of what df's rows give is dealt into: so many for each part
    that df is read in, so that a part does not grow with the input. Nothing is computed."""
    read_in = df._jdf.queryExecution().toRdd().getNumPartitions()
    return max(partitions(df.sparkSession, least), times * read_in)


def fold(doc_id, parts: int = 5):
    """crc32 of the decimal doc_id, modulo parts; null ids count as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def unlike(columns: list[str], *names: str) -> list[str]:
    """The names, with as many _ before them as make them clash with no column (Spark's names know no case)."""
    taken = {c.lower() for c in columns}
    lead = "_"
    while any(f"{lead}{n}".lower() in taken for n in names):
        lead += "_"
    return [f"{lead}{n}" for n in names]


def numbered(df: DataFrame, count: str, name: str, step: int = 4096) -> DataFrame:
    """Each row `count` times, numbered from 0 as `name`; in two steps, so that no array is long."""
    chunk, = unlike(df.columns, "chunk")
    n, zero = F.col(count).cast("long"), F.lit(0).cast("long")
    held = df.withColumn(chunk, F.explode(F.sequence(zero, F.floor((n - 1) / step).cast("long"))))
    within = F.sequence(zero, F.least(F.lit(step - 1).cast("long"), n - 1 - F.col(chunk) * step))
    return held.withColumn(name, F.explode(within)).withColumn(name, F.col(name) + F.col(chunk) * step).drop(chunk)


@lru_cache(maxsize=1)
def _trim():
    """The C library's way to return freed memory, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def giving_back(run):
    """A function over batches that returns freed memory to the machine when its task ends:
    workers are used again, and what one stage has freed would count beside the next one's."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return whole


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Classes of bytes: 0 ends a token, and a token goes on as long as the class is one.
WORDS = np.ones(256, np.uint8)
WORDS[[32, 9, 10, 11, 12, 13]] = 0
#: Letters, digits, _ and all beyond ASCII; marks.
WORDS_AND_MARKS = WORDS * np.array([1 if chr(b).isalnum() or b == 95 or b > 127 else 2 for b in range(256)], np.uint8)
#: Letters, digits, _ and all beyond ASCII; each mark by itself.
WORDS_AND_EACH_MARK = np.where(WORDS_AND_MARKS == 2, np.arange(256) + 2, WORDS_AND_MARKS).astype(np.uint8)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D
BLOCK = 1 << 18


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    up = np.full(size, _BASE, np.uint64)
    down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _hash_block(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit value of each token's bytes: a polynomial in a random code of each byte, by prefix sums."""
    size = max(BLOCK, 1 << int(len(data)).bit_length())
    up, down = _powers(size)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODE[data] * up[: len(data)], dtype=np.uint64)])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def token_hashes(texts: pa.Array, classes: np.ndarray = WORDS, lower: bool = True, kinds: bool = False) -> tuple[np.ndarray, ...]:
    """Hashes of all texts' tokens in a row, and where each text's tokens end among them;
    with `kinds` each token's class as well.

    A token is a run of bytes of one class; A-Z count as a-z with `lower`. Nulls have none.
    Arrays of a bounded block of bytes at a time, whatever the number and length of texts.
    """
    texts = texts.cast(pa.string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = _LOWER[data]
    kind = classes[data]
    # a token begins where the class differs from the byte's before, or a text begins
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    bounds = np.flatnonzero(edge)
    inside = kind[bounds[:-1]] > 0 if len(bounds) > 1 else np.zeros(0, bool)
    starts, ends = bounds[:-1][inside], bounds[1:][inside]
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, side="right")))
        low = starts[at]
        out[at:to] = _hash_block(data[low : ends[to - 1]], starts[at:to] - low, ends[at:to] - low)
        at = to
    found = out, np.searchsorted(starts, offsets[1:], side="left") if n else np.zeros(0, np.int64)
    return (*found, kind[starts]) if kinds else found


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, as UTF-8: bytes methods know exactly those letters and spaces."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
