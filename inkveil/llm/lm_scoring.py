"""Language-model scoring by a weighted backoff automaton over words."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, parts_of, settle, token_hashes

#: Names of n-grams are 56 bits, of which the last two tell the order: 0 words, 1 pairs, 2 triples. Of n
#: different n-grams some n^2 / 2^57 share a name with another: less than one of 3 x 10^8.
#: The end of a text is a token; it is also the state in which a text begins.
BITS = np.uint64(56)
END = np.uint64(0xE17A5C0DC)
ORDER = np.uint64(3)
STEP = np.uint64(0x9E3779B97F4A7C15)
GRAMS = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())])
ANSWERS = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("counts", pa.binary()), ("names", pa.int64())])
BLOCKS = pa.schema([("block", pa.int64()), ("docs", pa.binary())])


def ddl(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def word_name(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> (np.uint64(64) - BITS)) & ~ORDER


def longer(before: np.ndarray, word: np.ndarray, order: int) -> np.ndarray:
    """The name of the n-gram that a word makes with the one before it."""
    return word_name(mix64(mix64(before) * STEP + word)) | np.uint64(order)


class Automaton:
    """The model's states and arcs for single texts, as dictionaries of n-grams (tuples of words).

    A state is the longest seen end, of two words at most, of what was read. An arc of a
    state, where the n-gram was seen, bears its smoothed probability and leads to the
    longest seen end of the n-gram; the failure arc bears what the state leaves to unseen
    words and leads to the state without its first word, the root in the end, whose arcs
    are the words, the unknown ones as one.
    """

    def __init__(self, counts: dict[tuple, int], tokens: int, discount: float, masses: tuple[float, float]):
        self.counts, self.tokens, self.discount, self.masses = counts, tokens, discount, masses
        self.types = sum(len(g) == 1 for g in counts)

    def arc(self, state: tuple, word) -> float | None:
        """The weight of a state's arc, None where it has none."""
        c = self.counts.get((*state, word), 0)
        if not state:
            return math.log10((c - self.discount) / self.tokens if c else self.discount * self.types / self.tokens if self.tokens else 1.0)
        if not c:
            return None
        mass = self.masses[len(state) - 1]
        return math.log10((c + mass * 10 ** self.walk(state[1:], word)) / (self.counts[state] + mass))

    def walk(self, state: tuple, word) -> float:
        """The weight of reading a word in a state: failure arcs up to one that has the word's arc."""
        total = 0.0
        while (step := self.arc(state, word)) is None:
            mass = self.masses[len(state) - 1]
            total += math.log10(mass / (self.counts[state] + mass))
            state = state[1:]
        return total + step

    def score(self, words: list) -> float:
        """log10 probability of a text's words and its end (None), left to right."""
        state, total = (None,) if self.counts.get((None,)) else (), 0.0
        for word in [*words, None]:
            total += self.walk(state, word)
            state = (*state, word)[-2:]
            while state and state not in self.counts:
                state = state[1:]
        return total


def shard_of(grams: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of names: a shard's names lie close, and so their differences are small."""
    return ((grams >> (BITS - np.uint64(32))) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def planes(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as differences, byte by byte, so that what is alike stands together."""
    return zstandard.compress(np.ascontiguousarray(np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unplanes(packed: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(8, -1).T).reshape(-1).view(np.uint64), dtype=np.uint64)


def small(values: np.ndarray) -> bytes:
    """Counts as bytes; those from 255 on follow apart, with their places."""
    big = np.flatnonzero(values >= 255)
    head = np.array([len(big)], np.int64).tobytes()
    return zstandard.compress(head + np.minimum(values, 255).astype(np.uint8).tobytes() + big.astype(np.int64).tobytes() + values[big].astype(np.int64).tobytes(), 1)


def unsmall(packed: bytes) -> np.ndarray:
    packed = zstandard.decompress(packed)
    n = int(np.frombuffer(packed[:8], np.int64)[0])
    end = len(packed) - 16 * n
    out = np.frombuffer(packed[8:end], np.uint8).astype(np.int64)
    out[np.frombuffer(packed[end : end + 8 * n], np.int64)] = np.frombuffer(packed[end + 8 * n :], np.int64)
    return out


def _blocks(batches, hold: int):
    """Texts in blocks of `hold` tokens or a little more: (block, doc_ids, tokens with the
    ends, tokens of each text). A block's name is its task's and its place there."""
    task = TaskContext.get().partitionId() << 32
    ids, lengths, held, count = [], [], [], 0

    def made():
        sizes = np.concatenate(lengths) + 1
        stream = np.full(int(sizes.sum()), END, np.uint64)
        inside = np.ones(len(stream), bool)
        inside[np.cumsum(sizes) - 1] = False
        stream[inside] = word_name(np.concatenate(held))
        return task, list(ids), stream, sizes

    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            hashes, ends = token_hashes(part.column("text"))
            ids += part.column("doc_id").to_pylist()
            lengths.append(np.diff(ends, prepend=0))
            held.append(hashes)
            count += len(hashes) + part.num_rows
            if count >= hold:
                yield made()
                task, ids, lengths, held, count = task + 1, [], [], [], 0
    if ids:
        yield made()


def _out_of(ids: list, held_out: int) -> np.ndarray:
    return np.array([zlib.crc32(str(i).encode() if i is not None else b"") % 5 == held_out for i in ids], bool)


def _names(stream: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token, the names of the pair and of the triple that it ends; a text's first
    token makes a pair with the begin, and its triple is 0, for none."""
    first = np.cumsum(sizes) - sizes
    before = np.concatenate([[END], stream[:-1]]).astype(np.uint64)
    before[first] = END
    pair = longer(before, stream, 1)
    triple = longer(np.concatenate([[END], pair[:-1]]).astype(np.uint64), stream, 2)
    triple[first] = 0
    return pair, triple


def _unique(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def _count(shards: int, held_out: int, hold: int):
    """Texts to rows: for each block and shard of names, the block's n-grams there and their training counts."""

    def run(batches):
        for block, ids, stream, sizes in _blocks(batches, hold):
            train = np.repeat(~_out_of(ids, held_out), sizes)
            pair, triple = _names(stream, sizes)
            grams, counts = [], []
            for names in (stream, pair, triple):
                used = names != 0
                some = _unique(names[used])
                seen = np.sort(names[used & train])
                grams.append(some)
                counts.append(np.searchsorted(seen, some, side="right") - np.searchsorted(seen, some, side="left"))
            grams, counts = np.concatenate(grams), np.concatenate(counts)
            order = np.argsort(grams)
            grams, counts = grams[order], counts[order]
            cuts = np.searchsorted(shard_of(grams, shards), np.arange(shards + 1))
            full = [s for s in range(shards) if cuts[s] < cuts[s + 1]]
            for at in range(0, len(full), 64):
                some = full[at : at + 64]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([block] * len(some), pa.int64()), pa.array([planes(grams[cuts[s] : cuts[s + 1]]) for s in some], pa.binary()), pa.array([small(counts[cuts[s] : cuts[s + 1]]) for s in some], pa.binary())],
                    schema=GRAMS,
                )

    return run


def _add(batches):
    """Rows by shard to answers: each block's n-grams' training counts over all blocks; and
    as block -1 the sums from which the root is smoothed. A shard is held at a time."""

    def answer(shard, rows):
        grams = [unplanes(g) for _, g, _ in rows]
        flat = np.concatenate(grams)
        order = np.argsort(flat, kind="stable")
        all_, first = np.unique(flat[order], return_index=True)
        total = np.add.reduceat(np.concatenate([unsmall(c) for _, _, c in rows])[order], first)
        words = total[(all_ & ORDER) == 0]
        sums = np.array([words.sum(), (words > 0).sum(), (words == 1).sum(), (words == 2).sum()], np.int64)
        for at in range(0, len(rows), 64):
            some = range(at, min(at + 64, len(rows)))
            names = [int(np.sum(grams[k], dtype=np.uint64).astype(np.int64)) for k in some]
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(some), pa.int32()), pa.array([rows[k][0] for k in some], pa.int64()), pa.array([small(total[np.searchsorted(all_, grams[k])]) for k in some], pa.binary()), pa.array(names, pa.int64())], schema=ANSWERS)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([-1], pa.int64()), pa.array([sums.tobytes()], pa.binary()), pa.array([0], pa.int64())], schema=ANSWERS)

    shard, rows = None, []
    for batch in batches:
        for at, block, grams, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != shard and rows:
                yield from answer(shard, rows)
                rows = []
            shard = at
            rows.append((block, grams, counts))
    if rows:
        yield from answer(shard, rows)


def _pack(hold: int):
    """Texts to a row a block: doc_ids, lengths, and the tokens as places in the block's list of words."""

    def run(batches):
        for block, ids, stream, sizes in _blocks(batches, hold):
            words, place = np.unique(stream, return_inverse=True)
            order = np.argsort(-np.bincount(place, minlength=len(words)), kind="stable")  # frequent words get small numbers
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words), dtype=np.uint32)
            head = np.array([len(ids), len(words), len(stream)], np.int64).tobytes()
            missing = np.array([i is None for i in ids], np.uint8).tobytes()
            body = np.array([i or 0 for i in ids], np.int64).tobytes() + missing + sizes.astype(np.int64).tobytes()
            text = np.ascontiguousarray(rank[place].view(np.uint8).reshape(-1, 4).T).tobytes()
            listed = planes(words[order])  # in runs of one frequency, by name in each, so that differences are small
            docs = zstandard.compress(head + body + np.array([len(listed)], np.int64).tobytes() + listed + text, 3)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([docs], pa.binary())], schema=BLOCKS)

    return run


def _places(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted names without repeats, and each one's place among them."""
    order = np.argsort(names)
    held = names[order]
    new = np.append(True, held[1:] != held[:-1])
    place = np.empty(len(names), np.int64)
    place[order] = np.cumsum(new) - 1
    return held[new], place


def _score(tokens: int, types: int, discount: float, masses: tuple[float, float], held_out: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = zstandard.decompress(next(d for d in pdf["docs"] if d is not None))
        n, _, _ = np.frombuffer(raw[:24], np.int64)
        ids, raw = np.frombuffer(raw[24 : 24 + 8 * n], np.int64), raw[24 + 8 * n :]
        missing, raw = np.frombuffer(raw[:n], np.uint8) > 0, raw[n:]
        sizes, raw = np.frombuffer(raw[: 8 * n], np.int64), raw[8 * n :]
        size, raw = int(np.frombuffer(raw[:8], np.int64)[0]), raw[8:]
        words, raw = unplanes(raw[:size]), raw[size:]
        stream = words[np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).reshape(-1).view(np.uint32)]
        del raw
        pair, triple = _names(stream, sizes)
        first = np.cumsum(sizes) - sizes
        # the block's arcs: its words, pairs and triples with their training counts, which come in the order of names
        grams, place = _places(np.concatenate([stream, pair, triple]))
        answers = pdf[pdf["docs"].isna()].sort_values("shard")
        none = int(len(grams) > 0 and grams[0] == 0)
        if np.sum(grams, dtype=np.uint64) != np.sum(answers["names"].to_numpy(np.int64).view(np.uint64), dtype=np.uint64):
            raise RuntimeError("the input gave other rows when it was read again; write it to a table before scoring")
        counts = np.concatenate([np.zeros(none, np.int64), *[unsmall(c) for c in answers["counts"]]])
        c1, c2, c3 = counts[place].reshape(3, -1)
        begin = counts[np.searchsorted(grams, END)]
        del stream, pair, triple, grams, place, counts
        # a state's count is that of its own n-gram; a text begins in the state of the end
        h1, h2 = np.concatenate([[0], c1[:-1]]), np.concatenate([[0], c2[:-1]])
        h1[first], h2[first] = begin, 0
        p1 = np.where(c1 > 0, (c1 - discount) / max(1, tokens), discount * types / tokens if tokens else 1.0)
        p2 = (c2 + masses[0] * p1) / (h1 + masses[0])
        arc1, arc2, arc3 = np.log10(p1), np.log10(p2), np.log10((c3 + masses[1] * p2) / (h2 + masses[1]))
        fail1, fail2 = np.log10(masses[0] / (h1 + masses[0])), np.log10(masses[1] / (h2 + masses[1]))
        has2, has3 = c2 > 0, c3 > 0
        leads = np.where(has2, 2, np.where(c1 > 0, 1, 0)).astype(np.int8)  # how long the state is that a word's arc leads to
        # one traversal left to right, all texts of the block abreast, the longest first
        rows = np.argsort(-sizes, kind="stable")
        starts, total = first[rows], np.zeros(n)
        state = np.full(n, 1 if begin else 0, np.int8)
        still = np.searchsorted(-sizes[rows], -np.arange(int(sizes.max())), side="left")  # texts with a token at each place
        for t, live in enumerate(still.tolist()):
            at, s = starts[:live] + t, state[:live]
            by3 = (s == 2) & has3[at]
            by2 = (s > 0) & has2[at]
            two = np.where(by2, arc2[at], np.where(s > 0, fail1[at], 0.0) + arc1[at])
            total[:live] += np.where(by3, arc3[at], np.where(s == 2, fail2[at], 0.0) + two)
            state[:live] = leads[at]
        score = np.empty(n)
        score[rows] = total
        base = np.log10((c1 + 0.5) / (tokens + 0.5 * (types + 1)))
        return pd.DataFrame({
            "doc_id": pd.arrays.IntegerArray(ids.copy(), missing),
            "held_out": _out_of([None if gone else i for i, gone in zip(ids.tolist(), missing, strict=True)], held_out),
            "n_tokens": sizes, "n_known": np.add.reduceat((c1 > 0).astype(np.int64), first),
            "train_tokens": tokens, "base_score": np.add.reduceat(base, first), "score": score,
        })

    return run


#: A block has so many n-grams a shard at least, on the average, so that rows are worth their heads.
LEAST = 64


def shuffled(df: DataFrame) -> bool:
    """Whether a node of df's plan is a shuffle; names of columns don't count."""
    plan = df._jdf.queryExecution()
    return any(re.search(r"(?m)^[\s:+*()\d-]*\w*Exchange\b", str(p.toString())) for p in (plan.sparkPlan(), plan.executedPlan()))


def lm_scores(docs: DataFrame, held_out: int = 1, masses: tuple[float, float] = (100.0, 10.0), block_tokens: int = 2_000_000) -> DataFrame:
    """Score whole documents (doc_id, text) by a model of up to three words, of those whose
    crc32(doc_id as text) mod 5 is not `held_out`.

    Tokens are the words, A-Z lower-cased, and one end. The model is a backoff automaton:
    its states are the pairs, words and the root; P(w | u v) = (c(u v w) + m P(w | v)) /
    (c(u v) + m), the failure arc of a state bears m / (c(u v) + m), likewise for one word
    (`masses` are the two m), and at the root P(w) = (c(w) - d) / N, d from the numbers of
    words met once and twice, which leaves d V / N to all unknown words as one. A text is
    read once from left to right; the state is carried from word to word.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for
    each row of docs. A null text counts as empty (its end alone); a null doc_id has the
    text ''; no training rows leave every word unknown; equal rows have equal scores;
    no rows give no rows; other columns are ignored.

    No table of the model leaves its shards: tasks turn documents into blocks of some
    `block_tokens` tokens; each shard of n-grams adds up the blocks' counts and answers
    each block for the n-grams it has; a block's texts are read again and traverse the
    arcs that were answered. Both readings have to give the same rows in the same tasks: an
    input that comes out of a shuffle is settled first, and a difference is an error.
    """
    base = docs.select("doc_id", "text")
    if shuffled(base):
        base = settle(base)
    parts = parts_of(base, 64)
    shards = max(1, min(4 * parts, 3 * block_tokens // LEAST))
    counted = base.mapInArrow(_count(shards, held_out, block_tokens), ddl(GRAMS))
    added = settle(counted.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(_add, ddl(ANSWERS)))
    sums = np.zeros(4, np.int64)
    for row in added.filter("block = -1").select("counts").collect():  # four numbers a shard, of which there are 3 block_tokens / LEAST at most
        sums += np.frombuffer(row.counts, np.int64)
    tokens, types, once, twice = map(int, sums)
    discount = min(0.95, max(0.05, once / (once + 2 * twice) if once else 0.5))
    packed = base.mapInArrow(_pack(block_tokens), ddl(BLOCKS)).select("block", "docs", F.lit(-1).alias("shard"), F.lit(None).cast("binary").alias("counts"), F.lit(0).cast("long").alias("names"))
    met = packed.unionByName(added.filter("block >= 0").withColumn("docs", F.lit(None).cast("binary")))
    return met.groupBy("block").applyInPandas(
        _score(tokens, types, discount, masses, held_out),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
