"""Benchmark decontamination: windows of test items found in documents by Wu-Manber search."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK, _hash_block, giving_back, mix64, settle
from .words import Words, by_bytes, words

#: What a scan says of each document: spans of hit words as [from, to, from, to, ...], and the items.
FOUND = "n_words long, spans array<int>, items array<string>"
#: Window starts that one lane of the search goes through.
LANE = 256
#: Words of a piece of a long item, and text of a block of pieces.
PIECE, BLOCK_BYTES = 4096, 1 << 23
_ODD = np.uint64(0x9E3779B97F4A7C15)


def hashed(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """The words of texts and a 64-bit hash of each."""
    found = words(texts)
    out, at = np.empty(len(found.starts), np.uint64), 0
    while at < len(out):
        low = found.starts[at]
        to = max(at + 1, int(np.searchsorted(found.ends, low + BLOCK, side="right")))
        out[at:to] = _hash_block(found.data[low : found.ends[to - 1]], found.starts[at:to] - low, found.ends[at:to] - low)
        at = to
    return found, out


class Patterns:
    """The windows of one length of a block of pieces, and the tables to search them by.

    `shift` has, by a hash of two neighbouring words (one, for windows of one word), how far a
    window may be moved on: the least distance of that pair from the end of any window that
    has it, or past it. Distance 0 leads to the bucket of windows that end so: `keys` are
    sorted by the bucket and, within, by a hash of the whole window. Equal windows are one,
    with all their items.
    """

    def __init__(self, size: int, own: Words, hashes: np.ndarray, starts: np.ndarray, items: np.ndarray):
        self.size, self.block = size, min(2, size)
        self.own, self.hashes = own, hashes
        whole = self._whole(hashes, starts)
        order = np.argsort(whole, kind="stable")
        whole = whole[order]
        first = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]]))
        self.starts, self.items_at, self.items = starts[order[first]], np.append(first, len(order)), items[order]
        self.bits = min(24, max(10, int(8 * size * len(first)).bit_length()))
        self.shift = np.full(1 << self.bits, size - self.block + 1, np.uint16)
        for j in range(size - self.block + 1):
            np.minimum.at(self.shift, self._slot(hashes, self.starts + j), size - self.block - j)
        keys = self._keys(self._slot(hashes, self.starts + size - self.block), whole[first])
        self.rows = np.argsort(keys, kind="stable")
        self.keys = keys[self.rows]

    @staticmethod
    def _keys(slots: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return (slots.astype(np.uint64) << np.uint64(40)) | (whole >> np.uint64(24))

    def _whole(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for j in range(self.size):
            out = out * _ODD + hashes[at + j]
        return mix64(out)

    def _slot(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        value = hashes[at] if self.block == 1 else hashes[at] * _ODD + hashes[at + 1]
        return (mix64(value) >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, found: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, row) of all windows that stand in the texts, places counting all words."""
        last = found.first[1:] - self.size  # the last place of a window in each text
        lanes = np.maximum(0, -(-(last - found.first[:-1] + 1) // LANE))
        text = np.repeat(np.arange(len(last)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = found.first[:-1][text] + nth * LANE
        end = np.minimum(at + LANE - 1, last[text])
        hit_at, hit_slot = [], []
        while len(at):
            slot = self._slot(hashes, at + self.size - self.block)
            shift = self.shift[slot].astype(np.int64)
            stop = shift == 0
            if stop.any():
                hit_at.append(at[stop])
                hit_slot.append(slot[stop])
            at = at + np.maximum(shift, 1)
            going = at <= end
            at, end = at[going], end[going]
        if not hit_at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.concatenate(hit_at)
        key = self._keys(np.concatenate(hit_slot), self._whole(hashes, place))
        low, high = np.searchsorted(self.keys, key, side="left"), np.searchsorted(self.keys, key, side="right")
        many = high - low
        row = self.rows[np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        place = np.repeat(place, many)
        sure = np.array([_spelled(found, p, self.size) == _spelled(self.own, s, self.size) for p, s in zip(place.tolist(), self.starts[row].tolist(), strict=True)], bool)
        return place[sure], row[sure]


def _spelled(found: Words, at: int, size: int) -> bytes:
    return b" ".join(found.data[a:b].tobytes() for a, b in zip(found.starts[at : at + size].tolist(), found.ends[at : at + size].tolist(), strict=True))


def patterns(pieces: list[tuple[str, str]], window: int) -> list[Patterns]:
    """Tables by length of window: `window` words, or all words of an item that has fewer."""
    if not pieces:
        return []
    own, hashes = hashed(pa.array([t for _, t in pieces], pa.large_string()))
    names, item = np.unique(np.array([i for i, _ in pieces], object), return_inverse=True)
    counts, out = own.counts(), []
    for size in sorted({*np.minimum(counts, window).tolist()} - {0}):
        has = np.flatnonzero(np.minimum(counts, window) == size)
        many = counts[has] - size + 1
        piece = np.repeat(has, many)
        starts = own.first[piece] + np.arange(len(piece)) - np.repeat(np.cumsum(many) - many, many)
        out.append(Patterns(size, own, hashes, starts, names[item[piece]]))
    return out


def scan(texts: pa.Array, tables: list[Patterns]) -> tuple[np.ndarray, list[list[int]], list[list[str]]]:
    """Of each text the number of its words, the spans of its hit words and the items found."""
    found, hashes = hashed(texts)
    n, total = len(texts), len(found.starts)
    spans, items = [[] for _ in range(n)], [[] for _ in range(n)]
    cover, hits = np.zeros(total + 1, np.int64), []
    for t in tables:
        place, row = t.search(found, hashes)
        np.add.at(cover, place, 1)
        np.add.at(cover, place + t.size, -1)
        hits.append((np.searchsorted(found.first, place, side="right") - 1, row, t))
    if any(len(of) for of, _, _ in hits):
        inside = np.cumsum(cover)[:total] > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        # what touches at the border of two texts is two spans
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            at = int(np.searchsorted(found.first, a, side="right")) - 1
            while a < b:
                low, to = int(found.first[at]), min(b, int(found.first[at + 1]))
                if to > a:
                    spans[at] += [a - low, to - low]
                a, at = to, at + 1
        for of, row, t in hits:
            for d, r in {*zip(of.tolist(), row.tolist(), strict=True)}:
                items[d] += t.items[t.items_at[r] : t.items_at[r + 1]].tolist()
    return found.counts(), spans, [sorted({*x}) for x in items]


def _scan(pieces: list[tuple[str, str]], window: int, keys: list[str]):
    def run(batches):
        tables = patterns(pieces, window)
        for batch in batches:
            for a, b in by_bytes(batch.column("text")):
                part = batch.slice(a, b - a)
                counts, spans, items = scan(part.column("text"), tables)
                columns = [part.column(k) for k in keys] + [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "n_words", "spans", "items"])

    return run


def _cut(window: int):
    """Items to pieces of a bounded number of words, so cut that each window is in a piece."""

    def run(batches):
        for batch in batches:
            for a, b in by_bytes(batch.column("text")):
                part = batch.slice(a, b - a)
                found, ids, out = words(part.column("text")), part.column("item_id").to_pylist(), []
                for i, (low, high) in enumerate(zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True)):
                    for at in range(low, max(low + 1, high - window + 1), PIECE):
                        if high > low:
                            out.append((ids[i], _spelled(found, at, min(PIECE + window - 1, high - at)).decode()))
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.string()), pa.array([t for _, t in out], pa.string())], names=["item_id", "text"])

    return run


def _united(batches):
    """The spans of several scans in order, those that overlap or touch as one."""
    for batch in batches:
        out = []
        for flat in batch.column("spans").to_pylist():
            merged: list[int] = []
            for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)):
                if merged and a <= merged[-1]:
                    merged[-1] = max(merged[-1], b)
                else:
                    merged += [a, b]
            out.append(merged)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_words")), pa.array(out, pa.list_(pa.int32())), batch.column("items")], names=["doc_id", "n_words", "spans", "items"])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Find where items (item_id, text) of test sets stand in documents (doc_id, text).

    Returns doc_id, n_words, n_hit, n_items, items (their ids as text, sorted), spans (from,
    to, from, to... in words of the document, those hit), contaminated: a row for each row of
    docs. A word is a run of letters of a-z, digits and characters beyond ASCII, A-Z lower-cased.
    Windows are `window` consecutive words of an item, or all words of one that has fewer; a
    document's word is hit if it is inside any occurrence of a window.

    Null and empty texts, on either side, have no words. A null item_id is the text ''; items
    of one id are one. Repeated rows count by themselves, other columns are ignored, no
    documents give no rows, and without items nothing is hit.

    Items are cut into pieces, equal pieces are one, and pieces are dealt into blocks of about
    `block_bytes`, so that what is sent to the tasks is bounded: with one block the documents
    are read once, else once a block, numbered and settled before, and the blocks' spans are
    joined by document.
    """
    pieces = settle(items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").mapInArrow(_cut(window), "item_id string, text string").distinct())
    total = pieces.agg(F.sum(F.octet_length("text") + F.octet_length("item_id"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    block_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    held = lambda b: [(r.item_id, r.text) for r in pieces.filter(block_of == b).collect()]
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if blocks == 1:
        scanned = base.mapInArrow(giving_back(_scan(held(0), window, ["doc_id"])), f"doc_id long, {FOUND}")
    else:
        rows = settle(base.withColumn("row", F.monotonically_increasing_id()))
        scanned = None
        for b in range(blocks):
            one = rows.mapInArrow(giving_back(_scan(held(b), window, ["row", "doc_id"])), f"row long, doc_id long, {FOUND}")
            scanned = one if scanned is None else scanned.unionByName(one.filter("size(spans) > 0"))
        every = (F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        scanned = scanned.groupBy("row").agg(*every).drop("row").mapInArrow(_united, f"doc_id long, {FOUND}")
    hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return scanned.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans", (F.size("spans") > 0).alias("contaminated"))
