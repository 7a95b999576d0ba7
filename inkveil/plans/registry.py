"""Queries of the library's own operators, with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import detect_queries, image_queries, job_queries, process_queries, source_queries, stream_queries, text_queries
from .base import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms located in all documents, as page rectangles."""
    return text_queries.redaction_rects(spark, sf_dir)


MODULES = (text_queries, detect_queries, job_queries, image_queries, process_queries, stream_queries, source_queries)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
