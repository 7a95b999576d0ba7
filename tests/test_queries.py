"""Every query of the library that has SQL gives the SQL's rows."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from pyspark.sql import functions as F

from inkveil.functions.text import normalised_words
from inkveil.operators import matching
from inkveil.plans import registry
from inkveil.plans.text_queries import HYPHENS, TRUTH

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return "nan" if math.isnan(v) else f"{float(v):.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    want = duck.sql(registry.oracle_sql()[name])
    at = [want.columns.index(c) for c in sorted(want.columns)]
    assert sorted(df.columns) == sorted(want.columns)
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize(("stated", "holds"), [(TRUTH, matching.in_line), (HYPHENS, matching.hyphen_tail)])
def test_truth_tables(spark, stated, holds):
    rows = spark.createDataFrame(stated, "line string, term string, expected boolean")
    told = rows.withColumn("matched", holds(normalised_words(F.col("line")), normalised_words(F.col("term")))).collect()
    assert [r for r in told if r.matched != r.expected] == []


def test_payload_errors(spark):
    found = {r.id: r.errors for r in registry.queries()["payload_errors"](spark, SF).collect()}
    assert found[0] == found[2] == ""
    assert "not JSON" in found[1] and "fileKind is missing" in found[3] and "storageKind" in found[4]


def test_stream_of_deadlines_equals_the_batch(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    want = {str(r.event_id): "DONE" if math.floor(r.value * 30) <= 600 else "TIMED_OUT" for r in events.collect()}
    got = {r.job_id: r.outcome for r in registry.queries()["stream_deadlines"](spark, SF).collect()}
    assert got == want


def test_chunks_hold_the_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from inkveil.operators.detect import chunks

    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in chunks(docs, size=600, overlap=50).collect():
        assert len(r.chunk) <= 600 and r.chunk in texts[r.doc_id]


def test_service_failure_is_a_row(spark):
    rows = registry.queries()["detect_by_service"](spark, SF).collect()
    assert {r.rule_name for r in rows} == {"service"} and any(r.term == "Detection Failed" for r in rows)


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0
