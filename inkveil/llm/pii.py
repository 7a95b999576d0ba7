"""Personal data: base patterns, and contextual extraction bootstrapped from them."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS_AND_EACH_MARK, giving_back, mix64, settle, token_hashes, unlike

#: The kinds in their order, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: The first two so that a long run is read once: a match begins where a run does, or where the one before ended.
EMAIL_HERE = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
EMAIL_NEXT = re.compile(r"(?<![A-Za-z0-9._%+-])" + EMAIL_HERE.pattern)
IP_NEXT = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
SPACES = " \t\n\x0b\x0c\r"

#: A candidate instance: the token after a context, without these marks around it.
EDGES = "\"'`.,;:!?()[]{}<>*#&$%|="
#: Tokens of a context: runs of letters, digits and all beyond ASCII, and runs of one mark.
TOKEN = re.compile(r"[0-9A-Za-z_\x80-\U0010ffff]+|([^\x20\x09-\x0D0-9A-Za-z_\x80-\U0010ffff])\1*")
#: The word of a context that stands next to the instance has letters only.
CUE = re.compile(r"[^\W\d_]{2,}", re.UNICODE)
LOWER = {c: c + 32 for c in range(65, 91)}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base matches, code points, by start and then kind as listed."""
    if not text:
        return []
    out = []
    at = text.find("@")
    while at >= 0:
        # no match spans a space, so that the run of other characters around an @ decides alone
        begin = at
        while begin and text[begin - 1] not in SPACES:
            begin -= 1
        end = at
        while end < len(text) and text[end] not in SPACES:
            end += 1
        while (m := EMAIL_HERE.match(text, begin, end) or EMAIL_NEXT.search(text, begin, end)) is not None:
            out.append((m.start(), m.end(), 0))
            begin = m.end()
        at = text.find("@", end)
    for m in IP_NEXT.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            out.append((m.start(), m.end(), 1))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), 3))
    return [(s, e, KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2], x[1]))]


def shape_of(token: str) -> str | None:
    """The kind a token could be of, by its characters alone: what a context may discover."""
    digits = sum("0" <= c <= "9" for c in token)
    if "@" in token:
        return "email" if len(token) >= 5 and token[0] != "@" and token[-1] != "@" else None
    if digits < 4:
        return None
    rest = len(token) - digits
    if token.count(".") == 3 and rest == 3 and "0" <= token[0] <= "9":
        return "ip"
    if any(c not in "0123456789-.()+/" for c in token):
        return None
    return "card" if digits >= 12 else "phone" if digits >= 7 else None


def _around(text: str, at: int, step: int, most: int) -> list[str]:
    """The `most` tokens next to a position, nearest first, to the left (step -1) or right."""
    reach = 64
    while True:
        window = text[max(0, at - reach) : at] if step < 0 else text[at : at + reach]
        tokens = [m[0] for m in TOKEN.finditer(window)]
        if len(tokens) > most or len(window) < reach:
            return [t.translate(LOWER) for t in (tokens[::-1] if step < 0 else tokens)[:most]]
        reach *= 8


def _is_word(token: str) -> bool:
    return token[0].isalnum() or token[0] == "_" or token[0] > "\x7f"


def cues_of(text: str, start: int, end: int) -> list[tuple[str, str, str]]:
    """The lexical patterns around an instance, as (form, word, mark, further word):

    near: the word before it and the mark after that word; far: the same with the word
    before that one; after: the word after it and the mark before that word."""
    out = []
    left = _around(text, start, -1, 16)
    at = next((k for k, t in enumerate(left) if _is_word(t)), None)
    if at is not None and CUE.fullmatch(left[at]):
        mark = left[at - 1] if at else ""
        out.append(("near", left[at], mark, ""))
        further = next((t for t in left[at + 1 :] if _is_word(t)), "")
        out.append(("far", left[at], mark, further))
    right = _around(text, end, 1, 16)
    at = next((k for k, t in enumerate(right) if _is_word(t)), None)
    if at is not None and CUE.fullmatch(right[at]):
        out.append(("after", right[at], right[at - 1] if at else "", ""))
    return out


def _near(word: np.ndarray, mark: np.ndarray) -> np.ndarray:
    return mix64(word * np.uint64(0x9E3779B97F4A7C15) + mark + np.uint64(1))


def _far(near: np.ndarray, further: np.ndarray) -> np.ndarray:
    return mix64(near * np.uint64(0xC2B2AE3D27D4EB4F) + further + np.uint64(2))


def _after(word: np.ndarray, mark: np.ndarray) -> np.ndarray:
    return mix64(word * np.uint64(0x165667B19E3779F9) + mark + np.uint64(3))


def cue_hashes(cues: list[tuple[str, str, str, str]]) -> np.ndarray:
    """The patterns' 64-bit names."""
    if not cues:
        return np.zeros(0, np.uint64)

    def of(k):
        h, ends = token_hashes(pa.array([c[k] for c in cues], pa.string()), WORDS_AND_EACH_MARK)
        out = np.zeros(len(cues), np.uint64)
        out[np.diff(ends, prepend=0) > 0] = h
        return out

    word, mark, further = of(1), of(2), of(3)
    near = _near(word, mark)
    form = np.array([c[0] for c in cues])
    return np.where(form == "near", near, np.where(form == "far", _far(near, further), _after(word, mark)))


def cues_in(texts: pa.Array) -> np.ndarray:
    """Names of all patterns that stand anywhere in the texts, whatever is next to them."""
    h, ends, kinds = token_hashes(texts, WORDS_AND_EACH_MARK, kinds=True)
    if not len(h):
        return h
    of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    mark = kinds != 1
    follows = np.append((of[1:] == of[:-1]) & mark[1:], False)
    leads = np.append(False, (of[1:] == of[:-1]) & mark[:-1])
    words = np.flatnonzero(~mark)
    near = _near(h[words], np.where(follows, np.append(h[1:], np.uint64(0)), np.uint64(0)).astype(np.uint64)[words])
    same = np.append(False, of[words][1:] == of[words][:-1])
    further = np.where(same, np.append(np.uint64(0), h[words][:-1]), np.uint64(0)).astype(np.uint64)
    after = _after(h[words], np.where(leads, np.append(np.uint64(0), h[:-1]), np.uint64(0)).astype(np.uint64)[words])
    return np.concatenate([near, _far(near, further), after])


#: A token with an @ or at least four digits.
MAYBE = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]*?(?:@|[0-9](?:[^\x20\x09-\x0D0-9]*[0-9]){3})[^\x20\x09-\x0D]*")
LEAD = re.compile(r"[^\W\d_]{2,}[:=]+(?=.)")
#: Two or more groups of digits and joining marks, one space between; only marks stand around them.
RUN = re.compile(rf"(?<![^\x20\x09-\x0D])[{re.escape(EDGES)}]*+((?=[().+/-]*+[0-9])[0-9().+/-]++(?:\x20(?=[().+/-]*+[0-9])[0-9().+/-]++(?=[{re.escape(EDGES)}]*+(?:[\x20\x09-\x0D]|\Z)))++)")
GROUP = re.compile(r"[^\x20]+")
#: Digits of a run by kind: the least, the most, and with how many the first group is whole by itself.
RUN_DIGITS = {"card": (12, 19, 14), "phone": (7, 15, 10)}
SPAN_TYPE = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
CUE_TYPE = pa.struct([("cue", pa.string()), ("hash", pa.int64())])
SEEN_TYPE = pa.struct([("kind", pa.string()), ("cues", pa.list_(CUE_TYPE)), ("instance", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
FOUND_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("base_sha256", pa.string()), ("base", pa.list_(SPAN_TYPE)), ("seen", pa.list_(SEEN_TYPE))])
FOUND = "doc_id long, text_hash long, base_sha256 string, base array<struct<kind:string,start:int,end:int>>, seen array<struct<kind:string,cues:array<struct<cue:string,hash:bigint>>,instance:string,start:int,end:int,base:boolean>>"
#: The bitmap of cues has so many bits whatever their number; a false bit only costs a row.
BITS = 1 << 23


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


class Covered:
    """What spans cover, as disjoint parts in order; whether a span meets any of it is told by halving."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        self.starts, self.ends = [], []
        for s, e, _ in sorted(spans):
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, start: int, end: int) -> bool:
        at = bisect_right(self.ends, start)
        return at < len(self.starts) and self.starts[at] < end


def grouped(text: str, spans: list[tuple[int, int, str]], covered: Covered | None = None) -> dict[tuple[int, str], tuple[int, int]]:
    """By the place of its first token and kind, the (start, end) of each identifier in groups:
    the longest beginning of a run that has the kind's digits and no base match."""
    out, covered = {}, covered or Covered(spans)
    for m in RUN.finditer(text):
        digits = first = 0
        for g in GROUP.finditer(text, m.start(1), m.end(1)):
            if covered.meets(*g.span()):
                break
            digits += sum("0" <= c <= "9" for c in g[0])
            if g.start() == m.start(1):
                first = digits
            else:
                for kind, (least, most, whole) in RUN_DIGITS.items():
                    if least <= digits <= most and first < whole:
                        out[m.start(), kind] = (m.start(1), m.start(1) + len(text[m.start(1) : g.end()].rstrip(EDGES)))
            if digits > 19:
                break
    return out


def seen_in(text: str | None, spans: list[tuple[int, int, str]]) -> list[dict]:
    """Base matches and other identifier-like tokens or runs of groups, with their contexts."""
    out = [{"kind": k, "instance": text[s:e].lower(), "start": s, "end": e, "base": True} for s, e, k in spans]
    covered = Covered(spans)
    runs = grouped(text or "", spans, covered)
    for (_, kind), (s, e) in runs.items():
        out.append({"kind": kind, "instance": text[s:e].lower(), "start": s, "end": e, "base": False})
    for m in MAYBE.finditer(text or ""):
        token = m[0].strip(EDGES)
        lead = LEAD.match(token)
        token = token[lead.end() :] if lead else token  # what a name and a colon lead is sought without them
        if token and (kind := shape_of(token)) is not None and (m.start(), kind) not in runs:
            s = m.start() + m[0].rindex(token)
            e = s + len(token)
            if not covered.meets(s, e):
                out.append({"kind": kind, "instance": token.lower(), "start": s, "end": e, "base": False})
    for x in out:
        x["cues"] = cues_of(text, x["start"], x["end"])
    return [x for x in out if x["cues"]]


def _scan(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            out: dict[str, list] = {"base_sha256": [], "base": [], "seen": []}
            for text in part.column("text").to_pylist():
                spans = base_spans(text)
                out["base_sha256"].append(hashlib.sha256(joined(spans).encode()).hexdigest())
                out["base"].append([{"kind": k, "start": s, "end": e} for s, e, k in spans])
                out["seen"].append(seen_in(text, spans))
            named = [x for some in out["seen"] for x in some]
            hashes = iter(cue_hashes([c for x in named for c in x["cues"]]).astype(np.int64).tolist())
            for x in named:
                x["cues"] = [{"cue": " ".join(c), "hash": next(hashes)} for c in x["cues"]]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), *(pa.array(out[f.name], f.type) for f in list(FOUND_SCHEMA)[2:])], schema=FOUND_SCHEMA)


def _count_cues(bitmap):
    """How often each pattern of the bitmap stands anywhere; combined within a task."""

    def run(batches):
        bits = np.frombuffer(bitmap.value, np.uint8)
        names, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                h = cues_in(batch.column("text").slice(at, 512))
                slot = (h % np.uint64(BITS)).astype(np.int64)
                h = h[(bits[slot >> 3] >> (slot & 7)) & 1 == 1]
                if len(h):
                    all_, place = np.unique(np.concatenate([names, h]), return_inverse=True)
                    counts = np.bincount(place, weights=np.concatenate([counts, np.ones(len(h), np.int64)]), minlength=len(all_)).astype(np.int64)
                    names = all_
                    if len(names) > 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(counts)], names=["cue_hash", "times"])
                        names, counts = names[:0], counts[:0]
        if len(names):
            yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(counts)], names=["cue_hash", "times"])

    return run


def patterns_of(scanned: DataFrame, texts: DataFrame, support: int) -> DataFrame | None:
    """The graph of patterns and instances: (kind, cue_hash, before, instance, n, seed, times), where
    before tells whether the context precedes the instance, and times is how often the pattern stands in the texts, whatever is next to it. None if no
    pattern has `support` instances; the texts are then not read."""
    seen = scanned.select(F.explode("seen").alias("x")).select("x.kind", "x.instance", "x.base", F.explode("x.cues").alias("c"))
    before = ~F.col("c.cue").startswith("after")
    graph = seen.groupBy("kind", F.col("c.hash").alias("cue_hash"), before.alias("before"), "instance").agg(F.count("*").alias("n"), F.max("base").alias("seed"))
    # a pattern that no seed has can't start, but it can follow from instances that other patterns discover
    often = graph.groupBy("kind", "cue_hash").agg(F.count("*").alias("instances")).filter(F.col("instances") >= support).select("kind", "cue_hash")
    graph = settle(graph.join(often, ["kind", "cue_hash"]))
    if graph.filter("seed").groupBy("kind", "cue_hash").agg(F.count("*").alias("seeds")).filter(F.col("seeds") >= support).isEmpty():
        return None
    bitmap = texts.sparkSession.sparkContext.broadcast(_bitmap(graph))
    counted = texts.select("text").mapInArrow(giving_back(_count_cues(bitmap)), "cue_hash long, times long")
    times = counted.groupBy("cue_hash").agg(F.sum("times").alias("times"))
    return settle(graph.join(times, "cue_hash", "left").withColumn("times", F.greatest(F.coalesce("times", F.lit(1)), "n")))


def scores_of(graph: DataFrame, rounds: int, support: int, confident: float) -> DataFrame:
    """(kind, instance, score) after so many rounds: patterns by the instances that are believed,
    instances by their surest patterns on both sides."""
    scores = graph.groupBy("kind", "instance").agg(F.max(F.col("seed").cast("double")).alias("score"))
    surest = lambda side: F.coalesce(F.max(F.when(F.expr(side), F.col("confidence"))), F.lit(0.0))
    for _ in range(rounds):
        patterns = (
            graph.join(scores, ["kind", "instance"])
            .groupBy("kind", "cue_hash")
            .agg((F.sum(F.when(F.col("score") >= confident, F.col("score") * F.col("n")).otherwise(0.0)) / F.max("times")).alias("confidence"), F.count(F.when(F.col("score") >= confident, 1)).alias("believed"))
            .filter(F.col("believed") >= support)
            .select("kind", "cue_hash", F.least("confidence", F.lit(1.0)).alias("confidence"))
        )
        scores = settle(
            graph.join(patterns, ["kind", "cue_hash"], "left")
            .groupBy("kind", "instance")
            .agg(F.when(F.max("seed"), 1.0).otherwise(1 - (1 - surest("before")) * (1 - surest("NOT before"))).alias("score"))
        )
    return scores


def find_personal_data(docs: DataFrame, rounds: int = 3, support: int = 3, confident: float = 0.4) -> tuple[DataFrame, DataFrame]:
    """Base spans of every document, and further spans found by context.

    Seeds are the base matches. A pattern is a kind and a context: the word before an
    instance with the mark after it, the same with the word before that, or the word after
    it with the mark before. A pattern's confidence is the weight of its believed instances
    of that kind over all its occurrences in the collection, whatever is next to it; it counts
    with `support` different ones. An instance's score is 1 for a seed, else
    1 - (1 - b)(1 - a), b and a being the confidence of its surest pattern before and after
    it, as patterns of one side tell the same; identifier-like tokens that reach
    `confident` are believed and become spans, and believed instances feed the next round's patterns. An
    identifier may stand in groups with one space between: as a phone the longest
    beginning of the run with 7 to 15 digits, as a card the longest with 12 to 19.

    Returns (scanned, discovered): scanned has a row a document (doc_id, text_hash,
    base_sha256, base spans, seen); discovered has (doc_id, text_hash, more spans) for
    the documents with any. A null text has no spans; no rows give no rows.
    """
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    scanned = settle(base.mapInArrow(giving_back(_scan), FOUND))
    graph = patterns_of(scanned, base, support)
    if graph is None:
        return scanned, scanned.select("doc_id", "text_hash", F.col("base").alias("more")).limit(0)
    scores = scores_of(graph, rounds, support, confident)
    believed = scores.filter(F.col("score") >= confident).select("kind", "instance")
    discovered = (
        scanned.select("doc_id", "text_hash", F.explode("seen").alias("x"))
        .select("doc_id", "text_hash", "x.kind", "x.instance", "x.start", "x.end", "x.base")
        .filter("NOT base")
        .join(believed, ["kind", "instance"])
        .groupBy("doc_id", "text_hash")
        .agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("more"))
    )
    return scanned, settle(discovered)


def _bitmap(graph: DataFrame) -> bytes:
    """The cues' bits, or-ed within tasks and then together: BITS bits whatever their number."""

    def part(batches):
        bits = np.zeros(BITS >> 3, np.uint8)
        some = False
        for batch in batches:
            slot = (batch.column("cue_hash").to_numpy().view(np.uint64) % np.uint64(BITS)).astype(np.int64)
            np.bitwise_or.at(bits, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
            some |= len(slot) > 0
        if some:
            for at in range(0, len(bits), 1024):
                if bits[at : at + 1024].any():
                    yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([bits[at : at + 1024].tobytes()], pa.binary())], names=["at", "bits"])

    def merge(batches):
        held = {}
        for batch in batches:
            for at, b in zip(batch.column("at").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                x = np.frombuffer(b, np.uint8)
                held[at] = held[at] | x if at in held else x
        for at, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([x.tobytes()], pa.binary())], names=["at", "bits"])

    out = np.zeros(BITS >> 3, np.uint8)
    parts = graph.select("cue_hash").mapInArrow(part, "at long, bits binary").repartition(8, "at").mapInArrow(merge, "at long, bits binary")
    for row in parts.toLocalIterator():
        out[row.at : row.at + 1024] = np.frombuffer(row.bits, np.uint8)
    return out.tobytes()


def pii(docs: DataFrame, **options) -> DataFrame:
    """Personal data of every document (doc_id, text), as counts and spans.

    Returns doc_id, n_email, n_ip, n_card, n_phone (base matches), base_sha256, spans
    (base and discovered ones as kind:start:end by start, then kind as listed; code
    points, end exclusive), n_more: a row for each row of docs. A null text counts as
    empty; equal rows give equal results; other columns are ignored.
    """
    scanned, discovered = find_personal_data(docs, **options)
    order = F.create_map(*[F.lit(x) for k in zip(KINDS, range(4), strict=True) for x in k])
    spans = F.concat("base", F.coalesce("more", F.array().cast("array<struct<kind:string,start:int,end:int>>")))
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("s"), order[x["kind"]].alias("o"), x["end"].alias("e"), x["kind"].alias("k"))))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    found = discovered.select(F.col("doc_id").alias("with_id"), F.col("text_hash").alias("with_hash"), "more")
    return scanned.join(found, F.col("doc_id").eqNullSafe(F.col("with_id")) & (F.col("text_hash") == F.col("with_hash")), "left").select(
        "doc_id",
        *[count(k) for k in KINDS],
        "base_sha256",
        F.concat_ws(",", F.transform(keyed, lambda x: F.concat_ws(":", x["k"], x["s"], x["e"]))).alias("spans"),
        F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_more"),
    )


def _mask(more: str):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = []
                for text, found in zip(part.column("text").to_pylist(), part.column(more).to_pylist(), strict=True):
                    texts.append(masked(text, base_spans(text) + [(x["start"], x["end"], x["kind"]) for x in found or ()]))
                keep = part.drop_columns([more])
                yield keep.set_column(keep.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    return run


def masked(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """Text with each run of overlapping spans replaced by its first kind in brackets."""
    if not spans:
        return text
    out, at, end = [], 0, -1
    for s, e, kind in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))):
        if s >= end:
            out += [text[at:s] if s > at else "", f"[{kind.upper()}]"]
        at = end = max(end, e)
    return "".join([*out, text[at:]])


def mask_personal_data(docs: DataFrame, **options) -> DataFrame:
    """docs with personal data in `text` masked by kind, all columns kept; n_chars, where
    there is one, follows the text. Documents without spans stay as they are, as do null
    texts; equal rows are masked alike; other columns may have any names."""
    _, discovered = find_personal_data(docs, **options)
    more, with_id, with_hash = unlike(docs.columns, "more", "with_id", "with_hash")
    if discovered.isEmpty():
        wide = docs.withColumn(more, F.lit(None).cast("array<struct<kind:string,start:int,end:int>>"))
    else:
        found = discovered.select(F.col("doc_id").alias(with_id), F.col("text_hash").alias(with_hash), F.col("more").alias(more))
        wide = docs.join(found, F.col("doc_id").eqNullSafe(F.col(with_id)) & (F.xxhash64("text") == F.col(with_hash)), "left").select(*[F.col(f"`{c}`") for c in docs.columns], more)
    out = wide.mapInArrow(giving_back(_mask(more)), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
