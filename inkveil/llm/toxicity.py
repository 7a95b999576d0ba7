"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, with exception phrases."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, partitions, settle

#: Letters of other scripts that look like Latin ones, and marks and digits that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "г": "r", "п": "n",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l", "ɪ": "i", "ᴏ": "o", "ѵ": "v", "ց": "g", "օ": "o", "ո": "n", "ս": "u", "հ": "h",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}
BLANKS = "\t\n\x0b\x0c\r\"'`.,;:?()[]{}<>*#&%=_~^/\\-–—“”‘’«»…·"
UNSEEN = "​‌‍⁠﻿­"
TABLE = {ord(c): None for c in UNSEEN} | {ord(c): " " for c in BLANKS} | {ord(k): v for k, v in (HOMOGLYPHS | SUBSTITUTES).items()}
WORDS = re.compile(r"\S+").finditer
LENGTHS = (4, 5, 6, 7, 8, 10, 12)


def folded(text: str | None) -> str:
    """Text in lower case with look-alikes and substitutes as plain letters, marks as
    spaces, and a space at either end."""
    if not text:
        return " "
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return f" {text.lower().translate(TABLE)} "


def terms(word: str) -> list[str]:
    """Beginnings of a word that a lexicon may hold; short words stand for themselves."""
    return [word[:k] for k in LENGTHS if k <= len(word)] or ([word + " "] if len(word) == 3 else [])


class Lexicon:
    """Weighted word beginnings and exception phrases in one Aho-Corasick automaton."""

    def __init__(self, weights: dict[str, float], exceptions: list[str] = (), fit: tuple[float, float, float] = (-4.0, 1.0, 1.0)):
        self.weights, self.exceptions, self.fit, self.automaton = weights, list(exceptions), fit, None

    def __getstate__(self):
        return self.__dict__ | {"automaton": None}

    def hits(self, text: str) -> list[tuple[int, str]]:
        """(start, term) of the hits in a folded text that no exception phrase covers."""
        if not self.weights:
            return []
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for term in self.weights:
                self.automaton.add_word(f" {term}", (True, term))
            for phrase in self.exceptions:
                self.automaton.add_word(f" {phrase} ", (False, phrase))
            self.automaton.make_automaton()
        found, spared = [], []
        for end, (is_term, term) in self.automaton.iter(text):
            if is_term:
                found.append((end - len(term) + 1, term))
            else:
                spared.append((end - len(term), end))
        if not spared:
            return found
        # the phrases' runs, joined where they overlap; a hit is spared if its start lies in one
        starts = np.array(sorted(spared))
        ends = np.maximum.accumulate(starts[:, 1])
        at = np.searchsorted(starts[:, 0], [s for s, _ in found], side="right") - 1
        return [(s, t) for (s, t), k in zip(found, at.tolist(), strict=True) if k < 0 or ends[k] <= s]

    def measures(self, text: str) -> tuple[float, float]:
        """Weight of the hits, as log(1 + weight), and per hundred words, likewise."""
        weight = sum(self.weights[t] for _, t in self.hits(text))
        return math.log1p(weight), math.log1p(100 * weight / max(1, text.count(" ")))

    def score(self, text: str | None) -> float:
        a, b = self.measures(folded(text))
        z = self.fit[0] + self.fit[1] * a + self.fit[2] * b
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _contexts(batches):
    """Terms once a text; of toxic texts with the word before its first occurrence."""
    for batch in batches:
        toxic: set[tuple[str, int]] = set()
        other: Counter = Counter()
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = folded(text).split()
            if label:
                first: dict[str, str] = {}
                for before, word in zip(["", *words], words, strict=False):
                    for t in terms(word):
                        first.setdefault(t, before)
                toxic.update(first.items())
            else:
                other.update({t for word in set(words) for t in terms(word)})
        yield pa.RecordBatch.from_pydict(
            {"term": [t for t, _ in toxic] + list(other), "before": [b for _, b in toxic] + [None] * len(other), "texts": [None] * len(toxic) + list(other.values())},
            schema=pa.schema([("term", pa.string()), ("before", pa.string()), ("texts", pa.int64())]),
        )


def _phrases(lexicon: Lexicon):
    """Hits with a neighbouring word, by label."""

    def run(batches):
        for batch in batches:
            out: Counter = Counter()
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                text = folded(text)
                near = set()
                found = list(WORDS(text))
                words, places = [m[0] for m in found], [m.start() for m in found]
                for k in np.searchsorted(places, [s for s, _ in lexicon.hits(text)]).tolist():
                    near.add(" ".join(words[k : k + 2]))
                    near.add(" ".join(words[max(0, k - 1) : k + 1]))
                out.update((p, label) for p in near if " " in p)
            yield pa.RecordBatch.from_pydict({"phrase": [p for p, _ in out], "toxic": [y for _, y in out], "texts": list(out.values())}, schema=pa.schema([("phrase", pa.string()), ("toxic", pa.int32()), ("texts", pa.int64())]))

    return run


def _measured(lexicon: Lexicon):
    def run(batches):
        for batch in batches:
            got = [lexicon.measures(folded(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([a for a, _ in got], pa.float64()), pa.array([b for _, b in got], pa.float64())], names=["toxic", "a", "b"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Logistic regression with an intercept, by Newton's method; classes weigh the same."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (w * (y - p)) - ridge * len(y) * np.append(0, beta[1:])
        hessian = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.diag(np.append(1e-9, np.ones(len(beta) - 1)))
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, beta))


def learn(labelled: DataFrame, most: int = 1500, others: float = 2.0, sure: float = 1.0, least: int = 3, size: int = 2000) -> Lexicon:
    """Learn a lexicon from labelled texts (doc_id, text, toxic 0 or 1).

    A sample bounded by `most` toxic texts and `others` x `most` others, by hash of the
    doc_id, is used; rows with a null label are not. A term's weight is the log of its
    rate in toxic texts over that in others, where different words before it count once
    each, so that copies of one text weigh as one; terms whose weight less two standard
    errors exceeds `sure` enter, shorter ones first, up to `size`, strongest first. Phrases
    around hits that only other texts have, in `least` texts or more, become exceptions.
    """
    some = labelled.filter("toxic IN (0, 1)").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    sample = settle(some.filter("toxic = 1").orderBy(order).limit(most).unionByName(some.filter("toxic = 0").orderBy(order).limit(int(others * most))).repartition(partitions(labelled.sparkSession, 8), "doc_id", "text"))
    texts = dict(sample.groupBy("toxic").count().collect())
    n1, n0 = texts.get(1, 0), texts.get(0, 0)
    if not n1 or not n0:
        return Lexicon({}, fit=(30.0 if n1 else -30.0, 0.0, 0.0))
    seen = sample.mapInArrow(_contexts, "term string, before string, texts long")
    toxic = seen.filter("before IS NOT NULL").distinct().groupBy("term").agg(F.count("*").alias("t")).filter(F.col("t") >= least)
    other = seen.filter("before IS NULL").groupBy("term").agg(F.sum("texts").alias("c"))
    t, c = F.col("t") + 0.5, F.coalesce("c", F.lit(0)) + 0.5
    weight = F.log(t / (n1 + 1)) - F.log(c / (n0 + 1))
    strong = toxic.join(other, "term", "left").select("term", weight.alias("weight"), (weight - 2 * F.sqrt(1 / t + 1 / c)).alias("sure")).filter(F.col("sure") > sure)
    chosen: dict[str, float] = {}
    for row in sorted(strong.orderBy(F.desc("sure"), "term").limit(4 * size).collect(), key=lambda r: (len(r.term.strip()), r.term)):
        if len(chosen) < size and not any(row.term[:k] in chosen for k in range(3, len(row.term))):
            chosen[row.term] = float(row.weight)
    lexicon = Lexicon(chosen)
    phrases = sample.mapInArrow(_phrases(lexicon), "phrase string, toxic int, texts long").groupBy("phrase").agg(F.sum(F.when(F.col("toxic") == 1, F.col("texts")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("texts")).otherwise(0)).alias("c"))
    spared = [r.phrase for r in phrases.filter((F.col("t") == 0) & (F.col("c") >= least)).orderBy(F.desc("c"), "phrase").limit(size).collect()]
    lexicon = Lexicon(chosen, spared)
    rows = sample.mapInArrow(_measured(lexicon), "toxic int, a double, b double").toPandas()
    y = rows["toxic"].to_numpy(float)
    return Lexicon(chosen, spared, _logistic(rows[["a", "b"]].to_numpy(float), y))


def toxicity(docs: DataFrame, labels: DataFrame, held_out: int = 0, **options) -> DataFrame:
    """Score every document (doc_id, text) for toxicity, as labels (doc_id, toxic) mark it.

    Labels of rows whose crc32(doc_id as text) mod 5 is `held_out` are never learnt from.
    Returns doc_id, held_out, score (0 to 1), predicted (1 from 0.5): a row for
    each row of docs. A null text counts as empty, which has no hits; without labels of
    both kinds all texts score as the only kind there is, without any as not toxic; a
    doc_id that is labelled both ways is toxic; other columns are ignored.
    """
    base = docs.select("doc_id", "text")
    known = labels.filter(fold(F.col("doc_id")) != held_out).filter("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    limit = options.get("most", 1500)
    # only bounded samples of ids are joined with the texts
    picked = known.filter("toxic = 1").orderBy(F.xxhash64("doc_id")).limit(limit).unionByName(known.filter("toxic = 0").orderBy(F.xxhash64("doc_id")).limit(int(options.get("others", 2.0) * limit)))
    lexicon = learn(base.join(F.broadcast(picked), "doc_id"), **options)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = part.column("text").to_pylist()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array([lexicon.score(t) for t in texts], pa.float64())], names=["doc_id", "held_out", "score"])

    scored = base.select("doc_id", (fold(F.col("doc_id")) == held_out).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
