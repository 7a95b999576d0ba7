"""The language of texts, by character trigrams of a bounded labelled sample."""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters that trigrams are of, the space first; all others count as a space.
ALPHABET = " abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [*range(0xE0, 0xF7), *range(0xF8, 0x100), 0x153]))
OTHERS = "[^a-zà-öø-ÿœ]+"
LANGUAGES = ("en", "fr", "de", "es")
#: Labelled texts of a language that are fitted on at most; what is added to each count.
SAMPLE, SMOOTHING = 200, 0.5
#: Parts in which the sample is counted.
SPREAD = 16
#: A text's evidence counts as that of so many trigrams at most, as neighbours tell much the same.
EVIDENCE = 20
_CODE = np.zeros(0x180, np.int32)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
_SIDE = 64
#: Every letter's code by its code point, its capital's too; the last is no letter.
_LETTER = np.zeros(0x212D, np.int32)
for _c in ALPHABET[1:]:
    _LETTER[[ord(_c), *(ord(u) for u in (_c.upper(),) if len(u) == 1 and u.lower() == _c)]] = _CODE[ord(_c)]
_LETTER[[0x212A, 0x212B]] = _CODE[[ord("k"), ord("å")]]  # the signs of kelvin and angstrom
#: Characters of texts that are scored together.
TOGETHER = 1 << 20


def letters(text: Column) -> Column:
    """Lower-cased letters, all else as single spaces, one around the whole."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), OTHERS, " ")), F.lit(" "))


def fit(labelled: DataFrame, key: str = "doc_id", languages: tuple[str, ...] = LANGUAGES, most: int = SAMPLE, smoothing: float = SMOOTHING) -> DataFrame:
    """(gram, logs): of each trigram of the sample its log probability in each language, additively
    smoothed; the gram '' has those of an unseen one.

    labelled is (key, text, lang). Of each language the `most` texts are taken whose key's hash
    is the least, whole. The rows are bounded by the alphabet, whatever the sample.
    """
    own = labelled.filter(F.col("text").isNotNull()).withColumn("by", F.md5(F.col(key).cast("string")))
    sample = reduce(DataFrame.unionByName, [own.filter(F.col("lang") == c).orderBy("by", key).limit(most) for c in languages])
    grams = _grams(sample.repartition(SPREAD, "by"))  # what was the least of all comes in one part a language
    counts = grams.groupBy("gram").agg(*[F.count(F.when(F.col("lang") == c, 1)).alias(c) for c in languages])
    # one row, bounded as the model is: the sample is read once for the counts and their totals
    whole = counts.agg(F.collect_list(F.struct("gram", *languages)).alias("rows"), *[F.sum(c).alias(f"n_{c}") for c in languages], F.count("*").alias("kinds"))
    unseen = F.struct(F.lit("").alias("gram"), *[F.lit(0).cast("long").alias(c) for c in languages])
    logs = lambda r: F.array(*[F.log((r[c] + smoothing) / (F.coalesce(f"n_{c}", F.lit(0)) + smoothing * (F.col("kinds") + 1))) for c in languages])
    rows = F.transform(F.concat("rows", F.array(unseen)), lambda r: F.struct(r["gram"].alias("gram"), logs(r).alias("logs")))
    return whole.select(F.explode(rows).alias("r")).select("r.*")


def _grams(sample: DataFrame) -> DataFrame:
    held = sample.select("lang", letters(F.col("text")).alias("s")).filter("length(s) > 2")
    # by a look ahead at each place: a substring would be sought from the text's beginning each time
    return held.select("lang", F.explode(F.regexp_extract_all("s", F.lit("(?=(.{3}))"), 1)).alias("gram"))


def spelled(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, low, n): what `letters` gives of each text, as codes in a row, in which texts share the space
    between them; text i has n[i] trigrams, the first of which begins at low[i]."""
    # the capital i with a point is an i and a point in lower case
    joined = " ".join(["", *(t.replace("İ", "i ") for t in texts), ""])
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    codes = _LETTER.take(points, mode="clip")  # the last is no letter
    keep = codes > 0
    keep[1:] |= codes[:-1] > 0
    keep[0] = True
    at = np.cumsum(keep) - 1
    ends = np.cumsum([0, *(len(t) + t.count("İ") + 1 for t in texts)])
    low = at[ends]
    return codes[keep], low[:-1], np.maximum(0, np.diff(low) - 1)


def _tables(sent: pa.Array, n_languages: int) -> list[np.ndarray]:
    """Of each language the logs of all trigrams, by their codes; `sent` has the model's rows."""
    grams, logs = sent.field("gram").to_pylist(), np.array(sent.field("logs").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, n_languages)
    unseen = next((row for gram, row in zip(grams, logs, strict=True) if gram == ""), np.zeros(n_languages))
    seen = np.array([gram != "" for gram in grams], bool)
    codes = _CODE[np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32)].reshape(-1, 3)
    table = np.tile(unseen, (_SIDE**3, 1))
    table[(codes[:, 0] * _SIDE + codes[:, 1]) * _SIDE + codes[:, 2]] = logs[seen]
    return [np.ascontiguousarray(table[:, c]) for c in range(n_languages)]


def _scores(n_languages: int, text: str, batches):
    tables = None
    for batch in batches:
        if tables is None:
            tables = _tables(batch.column("sent__").slice(0, 1).flatten(), n_languages)
        keep = batch.drop_columns(["sent__"])
        sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + TOGETHER, side="right")))
            part = keep.slice(low, high - low)
            codes, starts, n = spelled(pc.fill_null(part.column(text), "").to_pylist())
            grams = (codes[:-2] * _SIDE + codes[1:-1]) * _SIDE + codes[2:]
            sums, some = np.zeros((part.num_rows, n_languages)), np.flatnonzero(n)
            if len(some):
                edges = np.stack([starts[some], starts[some] + n[some]], axis=1).ravel()
                for c, table in enumerate(tables):
                    sums[some, c] = np.add.reduceat(np.append(table[grams], 0.0), edges)[::2]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n), pa.array(list(sums), pa.list_(pa.float64()))], names=[*keep.schema.names, "n__", "sums__"])
            low = high


def with_shares(docs: DataFrame, model: DataFrame, name: str = "shares", languages: tuple[str, ...] = LANGUAGES, text: str = "text") -> DataFrame:
    """docs with `name`, a map from each language to its share: log-linear in the mean log probability
    of the text's trigrams, which counts as that of EVIDENCE trigrams at most. A text without a
    trigram, and a null, has the same share of all. The model is sent to each task when the
    plan runs; it is bounded by its alphabet."""
    from .matching import _on_first_rows

    sent = model.agg(F.collect_list(F.struct("gram", "logs")).alias("rows")).scalar()
    held = docs.withColumn("sent__", _on_first_rows(sent))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), "n__ long, sums__ array<double>"])
    scored = held.mapInArrow(partial(_scores, len(languages), text), schema)
    z = F.transform("sums__", lambda s: F.when(F.col("n__") > 0, s / F.col("n__") * F.least(F.col("n__"), F.lit(EVIDENCE))).otherwise(0.0))
    scored = scored.withColumn("sums__", z)
    powers = F.transform("sums__", lambda x: F.exp(x - F.array_max("sums__")))
    scored = scored.withColumn("sums__", powers)
    total = F.aggregate("sums__", F.lit(0.0), lambda a, x: a + x)
    shares = F.map_from_arrays(F.array(*[F.lit(c) for c in languages]), F.transform("sums__", lambda x: x / total))
    return scored.withColumn(name, shares).drop("n__", "sums__")


def long_enough(text: Column, min_chars: int, min_words: int) -> Column:
    """Whether a text has so many characters, runs of white space as one and none around, and so many
    words. What a text's beginning has, the whole has too, so that most are told by that."""

    def holds(some: Column) -> Column:
        plain = F.trim(F.regexp_replace(some, "\\s+", " "))
        return (F.length(plain) >= min_chars) & (F.size(F.split(plain, " ")) >= min_words)

    return F.when(holds(F.substring(text, 1, 16 * max(min_chars, min_words))), True).otherwise(holds(text))


def is_language(docs: DataFrame, model: DataFrame, name: str = "is_english", language: str = "en", threshold: float = 0.90, margin: float = 0.20, min_chars: int = 20, min_words: int = 3, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """docs with a column that tells whether the text is of the language: its share reaches the
    threshold and is the margin ahead of any other's; short texts are not. A null text is let
    through (true)."""
    told = with_shares(docs, model, "shares__", languages)
    own = F.col("shares__")[language]
    others = F.greatest(*[F.col("shares__")[c] for c in languages if c != language])
    found = long_enough(F.col("text"), min_chars, min_words) & (own >= threshold) & (own - others >= margin)
    return told.withColumn(name, F.when(F.col("text").isNull(), True).otherwise(F.coalesce(found, F.lit(False)))).drop("shares__")
