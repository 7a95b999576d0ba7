"""Quality rules: counts of the text, and tokeniser fertility with bands per script."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: The vocabularies of the public tokenisers are files of an installed package; its file names are parameters.
BYTE_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"

#: For texts of a language without enough good examples, bands by script of (characters per token of the byte vocabulary, share of characters for
#: which the piece vocabulary falls back to bytes, token entropy in bits per token over its most for that many tokens),
#: as (low, high); what falls outside is rejected. Wide on purpose: a text of prose in a
#: language that the vocabulary knows badly must stay.
BANDS = {
    "LATIN": ((1.75, 12.0), (0.0, 0.20), (0.35, 1.0)),
    "CYRILLIC": ((0.6, 12.0), (0.0, 0.30), (0.35, 1.0)),
    "GREEK": ((0.5, 12.0), (0.0, 0.50), (0.35, 1.0)),
    "": ((0.25, 12.0), (0.0, 0.95), (0.25, 1.0)),
}
SYMBOLS = frozenset("#*$%&|<>")
MEASURES = ("chars_per_token", "fallback_share", "token_entropy")
ROWS = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, chars_per_token double, fallback_share double, token_entropy double, script string"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), *((c, pa.float64()) for c in MEASURES), ("script", pa.string())])


def path_of(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def byte_encoding(path: str | None):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path or path_of(BYTE_VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def piece_model(path: str | None):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path or path_of(PIECE_VOCABULARY))


@lru_cache(maxsize=100_000)
def script_of(char: str) -> str:
    return unicodedata.name(char, "").split(" ")[0] if char.isalpha() else ""


#: Words of so many characters at most are remembered.
LONGEST = 200


class Fertility(dict):
    """Per word, its tokens of the byte vocabulary, packed; and the piece vocabulary's characters.

    The byte vocabulary splits before each space, so that a word with its leading space
    is encoded alike wherever it stands; the memory is bounded by starting over, and longer
    words than LONGEST are encoded anew each time, so that its bytes are bounded too. The
    piece vocabulary falls back to bytes for just those characters that are no piece.
    """

    def __init__(self, byte_path: str | None, piece_path: str | None, most: int = 200_000):
        self.encode, model, self.most = byte_encoding(byte_path).encode_ordinary, piece_model(piece_path), most
        self.known = frozenset(p for i in range(model.get_piece_size()) if len(p := model.id_to_piece(i)) == 1) | set(" \n\t\r\x0b\x0c")

    def __missing__(self, word: str) -> bytes:
        value = np.array(self.encode(" " + word), dtype=np.uint32).tobytes()
        if len(word) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value


@lru_cache(maxsize=2)
def fertility_of(byte_path: str | None, piece_path: str | None) -> Fertility:
    """One memory a worker process."""
    return Fertility(byte_path, piece_path)


def split_words(text: str) -> list[str]:
    """Runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return."""
    for space in "\n\t\r\x0b\x0c":  # a text without it is not copied
        text = text.replace(space, " ")
    return [w for w in text.split(" ") if w]


def numbered_words(words: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """The different words by number, in order of their first place, and each place's number."""
    number: defaultdict[str, int] = defaultdict(count().__next__)
    return number, np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))


def repeated(words: list[str], window: int = 3) -> int:
    """How many of the words stand in a window that the text has twice or more."""
    number, ids = numbered_words(words)
    return repeated_numbers(ids, len(number), window)


def repeated_numbers(ids: np.ndarray, many: int, window: int = 3) -> int:
    """`repeated` of words by their numbers, of which there are so many."""
    n = len(ids)
    if n <= window:
        return 0
    if many >= 1 << 21:
        _, key = np.unique(np.stack([ids[i : n - window + 1 + i] for i in range(window)], axis=1), axis=0, return_inverse=True)
        key = key.reshape(-1)
    else:
        key = ids[: n - window + 1].copy()
        for i in range(1, window):
            key = key * many + ids[i : n - window + 1 + i]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    often = np.zeros(len(key), bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for i in range(window):
        covered[i : n - window + 1 + i] |= often
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    seen, out = set(), 0
    for line in text.split("\n"):
        if line in seen:
            out += 1
        elif line.strip(" \t\x0b\x0c\r"):
            seen.add(line)
    return out


def characters_of(text: str) -> dict[str, int]:
    """How often a text has each of its characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) and codes.max() >= 1 << 16:
        found, times = np.unique(codes, return_counts=True)
    else:
        every = np.bincount(codes)
        found = np.flatnonzero(every)
        times = every[found]
    return dict(zip(map(chr, found.tolist()), times.tolist(), strict=True))


#: Tokens of so many different words are few.
FEW = 4096


def measure(text: str | None, fertility: Fertility) -> tuple:
    """The base counts and the three measures of a text, and its main script."""
    text = text or ""
    number, ids = numbered_words(split_words(text))
    n, different = len(ids), len(number)
    n_repeat = repeated_numbers(ids, different)
    failed = n < 50 or 100 * n_repeat > 50 * n
    often = np.bincount(ids, minlength=different)
    packed = [fertility[w] for w in number]
    tokens = np.frombuffer(b"".join(packed), dtype=np.uint32)
    times = np.repeat(often, np.fromiter(map(len, packed), dtype=np.int64, count=different) >> 2)
    n_tokens = int(times.sum())
    chars = int((np.fromiter(map(len, number), dtype=np.int64, count=different) * often).sum())
    characters = characters_of(text)
    fallback = sum(t for c, t in characters.items() if c not in fertility.known)
    letters: Counter = Counter()
    for c, t in characters.items():
        letters[script_of(c)] += t
    letters.pop("", None)
    most = max(letters.values(), default=0)
    leading = [x for x, t in letters.items() if t == most]
    script = leading[0] if len(leading) == 1 else next((x for x in map(script_of, text) if x in leading), "")
    per_token = (chars + n) / n_tokens if n_tokens else 0.0
    share = fallback / chars if chars else 0.0
    if len(tokens) < FEW:  # an array over the vocabulary costs more than sorting them
        c = np.bincount(np.unique(tokens, return_inverse=True)[1], weights=times) if n_tokens else np.zeros(0)
    else:
        c = np.bincount(tokens, weights=times)
        c = c[c > 0]
    if len(c) > 1:
        entropy = math.log2(n_tokens) - float((c * np.log2(c)).sum()) / n_tokens
        entropy /= math.log2(n_tokens)
    else:
        entropy = 0.0
    return n, chars, sum(characters.get(c, 0) for c in SYMBOLS), duplicate_lines(text), n_repeat, failed, per_token, share, entropy, script


#: Values of a measure are looked for in blocks of this width.
BLOCK = 1 / 4096


def bands_of(measured: DataFrame, labels: DataFrame, beyond: float, wider: float, enough: int) -> DataFrame:
    """(of_lang, bands) of the languages with `enough` good texts that pass the base rules, of all
    labels: for each measure what lies between its exact percentiles `beyond` and 1 - `beyond`
    (between neighbours in proportion), and `wider` times that width on either side.

    Equal values are one counted row. How many values each block has tells which blocks hold
    the four places that count, and only these are put in order: no task has all values.
    """
    fine = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality")).filter("quality = 1").select("doc_id")
    good = measured.filter("NOT base_failed").join(fine, "doc_id").select("lang", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(m).alias("v")) for k, m in enumerate(MEASURES)])).alias("m"))
    counted = settle(good.groupBy("lang", "m.k", "m.v").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("v") / BLOCK)))
    one = Window.partitionBy("lang", "k")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = counted.groupBy("lang", "k", "block").agg(F.sum("n").alias("many"))
    blocks = blocks.withColumn("ahead", F.coalesce(F.sum("many").over(before(one.orderBy("block"))), F.lit(0))).withColumn("texts", F.sum("many").over(one)).filter(F.col("texts") >= enough)
    low, high = F.lit(beyond) * (F.col("texts") - 1), F.lit(1 - beyond) * (F.col("texts") - 1)
    places = [F.floor(low), F.ceil(low), F.floor(high), F.ceil(high)]
    holds = [(F.col("ahead") <= at) & (at < F.col("ahead") + F.col("many")) for at in places]
    some = blocks.filter(holds[0] | holds[1] | holds[2] | holds[3]).select(F.col("lang").alias("of_lang"), F.col("k").alias("of_k"), F.col("block").alias("of_block"), "ahead", "texts")
    near = counted.join(some, F.col("lang").eqNullSafe(F.col("of_lang")) & (F.col("k") == F.col("of_k")) & (F.col("block") == F.col("of_block")))
    first = F.col("ahead") + F.coalesce(F.sum("n").over(before(Window.partitionBy("lang", "k", "block").orderBy("v"))), F.lit(0))
    near = near.withColumn("first", first)
    values = [F.max(F.when((F.col("first") <= at) & (at < F.col("first") + F.col("n")), F.col("v"))).alias(f"v{i}") for i, at in enumerate(places)]
    ends = near.groupBy("lang", "k", "texts").agg(*values).select("lang", "k", (F.col("v0") + (low - F.floor(low)) * (F.col("v1") - F.col("v0"))).alias("low"), (F.col("v2") + (high - F.floor(high)) * (F.col("v3") - F.col("v2"))).alias("high"))
    margin = wider * (F.col("high") - F.col("low"))
    found = ends.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", (F.col("low") - margin).alias("low"), (F.col("high") + margin).alias("high")))).alias("ends"))
    return found.select(F.col("lang").alias("of_lang"), F.transform("ends", lambda e: F.struct(e["low"].alias("low"), e["high"].alias("high"))).alias("bands"))


def quality_rules(docs: DataFrame, labels: DataFrame | None = None, beyond: float = 0.001, wider: float = 0.05, enough: int = 50, bands: dict | None = None, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """Count and judge every document (doc_id, text, lang).

    Returns doc_id, n_words, word_chars (code points in words), n_symbols, n_dup_lines,
    n_repeat_words (words in 3-word windows that the text has twice or more),
    base_failed (under 50 words, or over half of the words repeated), kept (not
    base_failed and all measures within the bands), and the measures: chars_per_token of
    the byte vocabulary, fallback_share of the piece vocabulary, token_entropy as a share
    of its most; script, and whether the bands are those of the language.

    The bands are those of the text's language where the labels (doc_id, quality) have
    `enough` good texts of it (`bands_of`), else those of the text's main script, which
    are wide. A null text has no words and fails; a null language is one by itself; null
    labels are not used; equal rows give equal results; no rows give no rows; other columns
    are ignored. Texts are read once and never moved.
    """
    limits = bands or BANDS
    base = docs.select("doc_id", "text", "lang") if "lang" in docs.columns else docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang"))

    def run(batches):
        fertility = fertility_of(byte_path, piece_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                columns = list(zip(*[measure(t, fertility) for t in part.column("text").to_pylist()], strict=True))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), *(pa.array(c, f.type) for c, f in zip(columns, list(SCHEMA)[2:], strict=True))], schema=SCHEMA)

    measured = base.mapInArrow(run, ROWS)
    by_script = F.array(*[F.struct(F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high")) for low, high in limits[""]])
    for script, some in limits.items():
        if script:
            by_script = F.when(F.col("script") == script, F.array(*[F.struct(F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high")) for low, high in some])).otherwise(by_script)
    if labels is not None:
        measured = settle(measured)
        # a row for each language
        measured = measured.join(F.broadcast(bands_of(measured, labels, beyond, wider, enough)), F.col("lang").eqNullSafe(F.col("of_lang")), "left")
    else:
        measured = measured.withColumn("bands", F.lit(None).cast("array<struct<low:double,high:double>>"))
    within = F.coalesce("bands", by_script)
    fine = F.lit(True)
    for k, m in enumerate(MEASURES):
        fine = fine & F.col(m).between(within[k]["low"], within[k]["high"])
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & fine).alias("kept"), *MEASURES, "script", F.col("bands").isNotNull().alias("by_language"),
    )
