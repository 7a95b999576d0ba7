"""Documents processed by stage: rules to proposals, annotations to masks, or annotations gone.

A processor takes documents of one kind of file. The stages are plans from documents and
rules to final rows; processors are found by the kind of file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settle
from . import detect, language, layout, masking, matching

HIGHLIGHT_KIND = 8


class ProcessingError(Exception):
    """Something that ends the processing of a job."""


class NonEnglishContent(ProcessingError):
    """The text is not English, or not enough of it."""


class NothingToRedact(ProcessingError):
    """There is no redaction to apply."""


class UnknownProcessor(ProcessingError, ValueError):
    """No processor is registered for the kind of file."""


class DuplicateProcessor(ProcessingError, ValueError):
    """A kind of file has a processor already."""


class UnprocessedImage(ProcessingError):
    """An image could not be looked at."""


#: The rules by default, as built-in detectors can run them.
DEFAULT_RULES = (
    {"kind": "pattern", "name": "contact", "label": "Contact", "pattern": "email", "spare": detect.PUBLIC_ENDS},
    {"kind": "pattern", "name": "telephone", "label": "Contact", "pattern": "phone"},
    {"kind": "pattern", "name": "insurance", "label": "Identity", "pattern": "national_insurance"},
    {"kind": "pattern", "name": "card", "label": "Identity", "pattern": "card"},
    {"kind": "pattern", "name": "address", "label": "Contact", "pattern": "ip"},
    {"kind": "plate", "name": "plates", "label": "Vehicle"},
)
_KINDS: dict[str, type[Processor]] = {}


class Processor:
    """What all processors have: a kind of file, and the three stages."""

    file_kind = ""

    def __init_subclass__(cls):
        if cls.file_kind in _KINDS:
            raise DuplicateProcessor(cls.file_kind)
        _KINDS[cls.file_kind] = cls

    def analyse(self, docs: DataFrame, rules: list[dict] = DEFAULT_RULES, model: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(proposed, status) of documents (doc_id, text).

        A text that is not English is blocked as a whole, by a fitted `model` (`language.fit`), or
        without one by its function words. proposed has a row a box of a term
        that a rule proposed for that document: (doc_id, term, title, page_no, line_no, first,
        last, left, top, right, bottom); status has a row a document: (doc_id, status, n_terms,
        n_boxes), BLOCKED or ANALYSED. A null text is let through and has no terms. Terms are
        sought in their own document alone. What was proposed, and where it stands, is settled:
        both results tell of one run of the rules, services among them.
        """
        held = docs.select("doc_id", "text")
        told = detect.with_language(held) if model is None else language.is_language(held, model)
        # of a blocked text nothing more is read
        told = settle(told.select("doc_id", F.when(F.col("is_english"), F.col("text")).alias("text"), "is_english"))
        open_ = told.filter("is_english").select("doc_id", "text")
        wanted = settle(detect.distinct_terms(detect.detect(open_, list(rules))).select("doc_id", "term"))
        # the term is its own id
        spans = settle(matching.word_spans(open_, wanted.withColumn("term_id", F.col("term")), own=True).withColumnRenamed("term_id", "term"))
        top = layout.line_top(F.col("line_no"))
        proposed = spans.select("doc_id", "term", F.lit("Text Redaction").alias("title"), layout.page_of(F.col("line_no")).alias("page_no"), "line_no", "first", "last", F.col("x0").alias("left"), top.alias("top"), F.col("x1").alias("right"), (top + layout.LINE_HEIGHT).alias("bottom"))
        counts = wanted.groupBy("doc_id").agg(F.count("*").alias("n_terms")).join(proposed.groupBy("doc_id").agg(F.count("*").alias("n_boxes")), "doc_id", "left")
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        status = told.join(counts, "doc_id", "left").select("doc_id", F.when(F.col("is_english"), "ANALYSED").otherwise("BLOCKED").alias("status"), zero("n_terms"), zero("n_boxes"))
        return proposed, status

    def redact(self, docs: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(lines, status) of documents whose annotations of any kind (doc_id, line_no, first, last)
        are applied: their words are masked. A document without any fails."""
        boxes = annotations.select("doc_id", "line_no", "first", "last")
        lines = masking.apply_redactions(docs, boxes, layout.lines(docs.select("doc_id", "text")))
        return lines, masking.boxes_status(docs, boxes)

    def sanitise(self, docs: DataFrame) -> DataFrame:
        """Documents without annotations and metadata, nothing masked."""
        return masking.sanitise(docs)


class TextProcessor(Processor):
    """Texts whose layout is told by their lines."""

    file_kind = "text"


def processor(file_kind: str) -> Processor:
    if file_kind not in _KINDS:
        raise UnknownProcessor(f"{file_kind}; known are {', '.join(sorted(_KINDS))}")
    return _KINDS[file_kind]()


def proposed_annotations(annotations: DataFrame) -> DataFrame:
    """Of a document's annotations those that propose a redaction: highlights alone."""
    return annotations.filter(F.col("kind") == HIGHLIGHT_KIND)


def final_annotations(annotations: DataFrame) -> DataFrame:
    """The annotations that count once a document was reviewed: all kinds."""
    return annotations.filter("kind IS NOT NULL")
