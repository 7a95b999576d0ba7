import pytest
from pyspark.sql import functions as F

from inkveil.operators import detect, evaluation, service
from inkveil.sources import connectors


def test_connectors(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "job-1.json").write_bytes(b"{}")
    (tmp_path / "in" / "other.txt").write_bytes("é".encode())
    c = connectors.connector("file", spark, str(tmp_path))
    assert {(r.name, r.n_bytes) for r in c.read().collect()} == {("job-1.json", 2), ("other.txt", 2)}
    assert [r.name for r in c.listing("in/job-").collect()] == ["in/job-1.json"]
    c.write(spark.range(3).withColumn("k", F.col("id") % 2), "out", by=("k",))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        c.write(spark.range(3), "out")
    with pytest.raises(ValueError, match="no connector"):
        connectors.connector("none", spark, "x")


def test_endpoint_needs_exactly_one():
    assert connectors.endpoint(url="https://a") == "https://a"
    for bad in ({}, {"name": "a", "url": "b"}):
        with pytest.raises(ValueError, match="either"):
            connectors.endpoint(**bad)


def test_json_lines(spark, tmp_path):
    df = spark.sql("SELECT 'é' AS a, TIMESTAMP '2026-01-02 03:04:05' AS t, CAST(NULL AS STRING) AS n")
    connectors.json_lines(df, str(tmp_path / "j"))
    assert [r.value for r in spark.read.text(str(tmp_path / "j")).collect()] == ['{"a":"é","t":"2026-01-02T03:04:05.000000Z"}']


def test_yaml_config():
    assert connectors.yaml_config("redactors:\n- redactor_type: X\n") == '{"redactors": [{"redactor_type": "X"}]}'
    with pytest.raises(ValueError, match="redactors"):
        connectors.yaml_config("a: 1")


def test_detector_registry():
    with pytest.raises(detect.UnknownDetector):
        detect.detector("none")
    with pytest.raises(TypeError):
        detect.detector(3)
    with pytest.raises(detect.DuplicateDetector):
        detect.register("pattern")(lambda docs, rule: docs)


def test_comparison_golden(spark):
    columns = "doc_id int, page_no int, text string, y0 double, y1 double"
    proposed = spark.createDataFrame([(1, 0, "Ann", 1.0, 2.0), (1, 0, "Bob,", 3.0, 4.0), (1, 1, "Cy", 1.0, 2.0)], columns)
    final = spark.createDataFrame([(1, 0, "Ann.", 1.0, 2.0), (1, 0, "Bob", 3.0, 4.0), (1, 0, "Dee", 9.0, 9.5), (1, 1, "Eve", 1.0, 2.0), (1, 7, "Gone", 0.0, 1.0)], columns)
    for match in ("any", "one_to_one"):
        assert evaluation.compare(proposed, final, match).collect() == [(1, 3, 4, 2, 1, 2)]
    with pytest.raises(ValueError, match="match is"):
        evaluation.compare(proposed, final, "some")


def test_plans_push_down_and_prune(spark):
    """The phrase search reads two columns of documents and joins by words, without a cross join."""
    from inkveil.plans import registry

    plan = registry.queries()["match_phrase"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_retries():
    seen, slept = [], []

    def call(text):
        seen.append(text)
        if len(seen) < 3:
            raise OSError("busy")
        return [text]

    assert service.with_retries(call, 5, sleep=slept.append)("a") == ["a"] and slept == [1.0, 2.0]
    with pytest.raises(ZeroDivisionError):
        service.with_retries(lambda t: 1 / 0, 2, sleep=slept.append)("a")


def test_responses_go_to_their_topics(spark, tmp_path):
    from inkveil.streaming.jobs import to_topics

    spark.createDataFrame([("1", "ALPHA"), ("2", "BETA_SERVICE"), ("3", None)], "id string, service string").write.parquet(str(tmp_path / "in"))
    to_topics(spark.readStream.schema("id string, service string").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"))
    rows = spark.read.text(f"{tmp_path}/out").collect()
    assert sorted((r.subject, r.value) for r in rows) == [("alpha", '{"id":"1","service":"ALPHA"}'), ("beta-service", '{"id":"2","service":"BETA_SERVICE"}')]
