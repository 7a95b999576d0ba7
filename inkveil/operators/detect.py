"""Detectors: rules that propose sensitive terms in documents.

A detector is a function (docs, rule) -> DataFrame[doc_id, rule_name, ordinal, term],
registered by the kind that rules name. Those here are built-in expressions; a service
can be put behind the same interface (`service_detector`), a stand-in offline.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plates
from . import service
from .language import long_enough

#: Patterns of the built-in rules. They mean the same to Java's and to RE2's engine.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "phone": r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
    "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "card": r"[0-9]{16}",
    "secret": r"token = \"[0-9a-f]{40}\"",
    "licence": r"This work is licensed under the [^.,\n]+",
    "url": r"https?://[A-Za-z0-9./_-]+",
    "national_insurance": r"[A-Z]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D]",
}
#: What any match of a built-in pattern has: a text without it is not searched.
NEEDED = {"email": "@", "phone": "+1 (", "ip": ".", "secret": 'token = "', "licence": "This work is licensed under the ", "url": "://"}
#: Ends of addresses that are public, and so no personal data.
PUBLIC_ENDS = (".gov.uk", ".org", ".gov.wales")
#: Frequent short words of four languages, by which a text's language is told.
FUNCTION_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "for", "on", "was", "be", "with", "as", "this", "by", "are", "from", "at", "or"),
    "fr": ("le", "la", "les", "des", "et", "un", "une", "du", "que", "pour", "dans", "est", "au", "qui", "sur", "pas", "par", "plus", "avec", "ce"),
    "de": ("der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch"),
    "es": ("el", "los", "las", "del", "se", "con", "para", "una", "su", "lo", "como", "más", "pero", "sus", "al", "y", "o", "es", "por", "en"),
}

#: Texts of a batch that are cut together.
TOGETHER = 64

Detector = Callable[[DataFrame, dict], DataFrame]
_REGISTRY: dict[str, Detector] = {}


class UnknownDetector(ValueError):
    """No detector is registered for this kind."""


class DuplicateDetector(ValueError):
    """A kind is registered already."""


def register(kind: str):
    """Register a detector for a kind of rule; a kind can be registered once."""
    if not isinstance(kind, str):
        raise TypeError(f"a kind is a string, not {type(kind).__name__}")
    if kind in _REGISTRY:
        raise DuplicateDetector(kind)

    def put(f: Detector) -> Detector:
        _REGISTRY[kind] = f
        return f

    return put


def detector(kind: str) -> Detector:
    if not isinstance(kind, str):
        raise TypeError(f"a kind is a string, not {type(kind).__name__}")
    if kind not in _REGISTRY:
        raise UnknownDetector(f"{kind}; known are {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[kind]


Terms = Callable[[dict], Column]
_TERMS: dict[str, Terms] = {}


def _proposals(docs: DataFrame, rules: list[dict]) -> DataFrame:
    """Proposals of rules whose terms are a column, all from one reading of the texts."""
    named = F.explode(F.array(*[F.struct(F.lit(r["name"]).alias("rule_name"), _TERMS[r["kind"]](r).alias("terms")) for r in rules])).alias("r")
    return docs.select("doc_id", named).select("doc_id", "r.rule_name", F.posexplode("r.terms").alias("ordinal", "term"))


def in_row(kind: str):
    """Register a detector whose terms are a column of the row's text."""

    def put(f: Terms) -> Terms:
        register(kind)(lambda docs, rule: _proposals(docs, [rule]))
        _TERMS[kind] = f
        return f

    return put


@in_row("pattern")
def pattern_terms(rule: dict) -> Column:
    """All matches of the rule's pattern, or of a built-in one by name; public addresses spared on demand."""
    found = F.regexp_extract_all("text", F.lit(f"({PATTERNS.get(rule['pattern'], rule['pattern'])})"), 0)
    if needed := NEEDED.get(rule["pattern"]):
        found = F.when(F.contains("text", F.lit(needed)), found)
    if spared := rule.get("spare"):
        found = F.filter(found, lambda t: ~reduce(lambda a, b: a | b, [F.lower(t).endswith(end) for end in spared]))
    return found


@in_row("dictionary")
def dictionary_terms(rule: dict) -> Column:
    """The rule's words that stand in the text, each once, in the rule's order."""
    words = F.split(F.lower("text"), "[^\\p{L}\\p{N}]+")
    return F.filter(F.array(*[F.lit(w.lower()) for w in rule["words"]]), lambda w: F.array_contains(words, w))


@in_row("plate")
def plate_terms(rule: dict) -> Column:
    """Vehicle registrations in either reading of 0/O and 1/I, in order of the alphabet."""
    return F.array_sort(plates(F.col("text")))


@register("service")
def service_detector(docs: DataFrame, rule: dict) -> DataFrame:
    """Terms that the rule's function names for each text: `call` maps a text to terms.

    Equal texts are sent once, under the rule's limits (`service.ask`), and the answers are
    settled. An error yields the row `failure` instead of failing the job; an empty text
    isn't sent.
    """
    call, failure = rule["call"], rule.get("failure")
    once = docs.filter("text <> ''").groupBy(F.sha2("text", 256).alias("id")).agg(F.first("text").alias("text"))
    answers = service.ask(once, {**rule, "call": lambda text, *room: (call(text, *room), 0, 0)})
    failed = F.array(F.lit(failure)) if failure else F.array().cast("array<string>")
    terms = F.when(F.col("error").isNull(), F.col("terms")).otherwise(failed)
    hashed = docs.select("doc_id", F.sha2("text", 256).alias("id"))
    return hashed.join(answers, "id").select("doc_id", F.lit(rule["name"]).alias("rule_name"), F.posexplode(terms).alias("ordinal", "term"))


def chunked_service(docs: DataFrame, rule: dict, size: int = 6000, overlap: int = 250) -> tuple[DataFrame, DataFrame]:
    """(proposals, calls) of a service that is asked about each document chunk by chunk.

    The rule's `call` maps a chunk to (terms, prompt_tokens, completion_tokens). Equal chunks
    are asked about once, under the rule's limits and budget (`service.ask`); the answers are
    settled, so that both results tell of the same calls. proposals are distinct in a document,
    in the order of its chunks: (doc_id, rule_name, ordinal, term); an empty text gives none.
    calls has a row a distinct chunk: (chunk_hash, n_terms, prompt_tokens, completion_tokens,
    error): a chunk that fails after all attempts, or that the budget left no room for, gives
    its error, and no terms, and doesn't fail the job.
    """
    parts, answers = asked_chunks(docs, rule, size, overlap)
    found = parts.select("doc_id", "chunk_no", "chunk_hash").join(answers, "chunk_hash").select("doc_id", "chunk_no", F.posexplode("terms").alias("at", "term"))
    first = found.groupBy("doc_id", "term").agg(F.min(F.struct("chunk_no", "at")).alias("first"))
    w = Window.partitionBy("doc_id").orderBy("first", "term")
    proposals = first.select("doc_id", F.lit(rule["name"]).alias("rule_name"), (F.row_number().over(w) - 1).alias("ordinal"), "term")
    return proposals, calls_of(answers)


def asked_chunks(docs: DataFrame, rule: dict, size: int = 6000, overlap: int = 250) -> tuple[DataFrame, DataFrame]:
    """(parts, answers): the chunks of each document (doc_id, chunk_no, chunk, chunk_hash), and what the service said of
    each distinct one (chunk_hash, terms, ...), settled."""
    parts = chunks(docs, size, overlap).withColumn("chunk_hash", F.sha2("chunk", 256))
    once = parts.groupBy(F.col("chunk_hash").alias("id")).agg(F.first("chunk").alias("text"))
    return parts, service.ask(once, rule).withColumnRenamed("id", "chunk_hash")


def calls_of(answers: DataFrame) -> DataFrame:
    """A row a distinct chunk that was asked about (`chunked_service`)."""
    return answers.select("chunk_hash", F.size("terms").cast("long").alias("n_terms"), "prompt_tokens", "completion_tokens", "error")


def detect(docs: DataFrame, rules: list[dict]) -> DataFrame:
    """The union of all rules' proposals; those whose terms are a column share one reading of the texts."""
    if not rules:
        raise ValueError("no rule is given")
    others = [detector(r["kind"])(docs, r) for r in rules if r["kind"] not in _TERMS]
    own = [r for r in rules if r["kind"] in _TERMS]
    return reduce(DataFrame.unionByName, [*([_proposals(docs, own)] if own else []), *others])


def distinct_terms(proposals: DataFrame) -> DataFrame:
    """(doc_id, term, first_ordinal): each term of a document once, line feeds as spaces."""
    return proposals.withColumn("term", F.replace("term", F.lit("\n"), F.lit(" "))).groupBy("doc_id", "term").agg(F.min("ordinal").alias("first_ordinal"))


def with_language(docs: DataFrame, name: str = "is_english", threshold: float = 0.90, margin: float = 0.20, min_chars: int = 20, min_words: int = 3) -> DataFrame:
    """docs with a column that tells whether the text is English: its share of the function words
    found reaches the threshold and is the margin ahead of any other language's; short texts
    are not. A null text is let through (true). The words are taken and counted once."""
    every = F.array(*[F.lit(w) for w in dict.fromkeys(w for ws in FUNCTION_WORDS.values() for w in ws)])
    words = F.filter(F.split(F.lower("text"), "[^\\p{L}]+"), lambda w: F.array_contains(every, w))
    zero = F.struct(*[F.lit(0).alias(k) for k in FUNCTION_WORDS])
    counts = F.aggregate(words, zero, lambda n, w: F.struct(*[(n[k] + w.isin(*known).cast("int")).alias(k) for k, known in FUNCTION_WORDS.items()]))
    hits = "_hits"
    while hits.lower() in {c.lower() for c in docs.columns}:
        hits = f"_{hits}"
    counted = docs.withColumn(hits, F.explode(F.array(counts)))  # a row each, worked out here once
    total = reduce(lambda a, b: a + b, [F.col(hits)[k] for k in FUNCTION_WORDS])
    most = F.greatest(*[F.col(hits)[k] for k in FUNCTION_WORDS if k != "en"])
    english = long_enough(F.col("text"), min_chars, min_words) & (total > 0) & (F.col(hits)["en"] / total >= threshold) & ((F.col(hits)["en"] - most) / total >= margin)
    return counted.withColumn(name, F.when(F.col("text").isNull(), True).otherwise(F.coalesce(english, F.lit(False)))).drop(hits)


def chunks(docs: DataFrame, size: int = 6000, overlap: int = 250, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> DataFrame:
    """(doc_id, chunk_no, chunk): texts cut at the coarsest separator that gives pieces of `size`
    at most, pieces put together up to `size`, each chunk beginning with up to `overlap`
    characters of the one before."""
    import pyarrow as pa

    def pieces(text: str, seps: tuple[str, ...]) -> list[str]:
        if len(text) <= size:
            return [text]
        sep = next(s for s in seps if not s or s in text)
        rest = seps[seps.index(sep) + 1 :]
        if not sep:
            return list(text[i : i + size] for i in range(0, len(text), size))
        parts = text.split(sep)
        return [q for k, p in enumerate(parts) for q in pieces(p + (sep if k < len(parts) - 1 else ""), rest)]

    def put_together(text: str) -> list[str]:
        out, held, length = [], [], 0
        for piece in pieces(text, separators):
            if held and length + len(piece) > size:
                out.append("".join(held))
                while held and (length > overlap or length + len(piece) > size):
                    length -= len(held.pop(0))
            held.append(piece)
            length += len(piece)
        return [c.strip() for c in [*out, "".join(held)] if c.strip()]

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, TOGETHER):  # a batch has 10,000 texts, whose chunks are not held at once
                part = batch.slice(low, TOGETHER)
                cut = [put_together(t) if t else [] for t in part.column("text").to_pylist()]
                of = pa.array([k for k, c in enumerate(cut) for _ in c], pa.int64())
                columns = [part.column("doc_id").take(of), pa.array([i for c in cut for i in range(len(c))], pa.int32()), pa.array([x for c in cut for x in c], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "chunk_no", "chunk"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, chunk_no int, chunk string")


def estimated_tokens(messages: DataFrame, reply: int = 1024, encoding=None) -> DataFrame:
    """(conv_id, tokens): 4 a message and its values' tokens, 2, and the reply's room. Tokens
    are an encoder's, or without one the words."""
    if encoding is None:
        n = F.size(F.split("text", " ")) + F.size(F.split("role", " "))
    else:
        counter = F.pandas_udf(lambda s: s.map(lambda t: len(encoding(t)) if t else 0), "int")
        n = counter(F.col("text")) + counter(F.col("role"))
    return messages.groupBy("conv_id").agg((F.sum(4 + n) + 2 + F.lit(reply)).alias("tokens"))

