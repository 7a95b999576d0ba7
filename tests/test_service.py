"""Calls of a service: scheduled under one quota, asked once, budgeted."""

import random
from collections import defaultdict

import pytest

from inkveil.operators import detect, images, processor, service


@pytest.mark.parametrize("parts", [1, 5])
def test_no_minute_is_over_the_quota(spark, parts):
    rng = random.Random(parts)
    requests = [(i, float(rng.choice((1, 5, 20, 90)))) for i in range(400)]
    rows = service.schedule(spark.createDataFrame(requests, "id long, weight double"), parts, tokens=1000, calls=60).collect()
    assert len(rows) == 400 and {r.part for r in rows} == set(range(parts))
    timed = sorted((r.start_s, r.weight) for r in rows)
    for start, _ in timed:
        minute = [w for s, w in timed if start <= s < start + 60]
        assert sum(minute) <= 1000 and len(minute) <= 60
    # the parts end together, and the quota is used but for what each part keeps back
    ends = defaultdict(float)
    for r in rows:
        ends[r.part] = max(ends[r.part], r.start_s)
    assert max(ends.values()) - min(ends.values()) < 60 and max(ends.values()) < 60 * max(400 / (60 - parts), sum(w for _, w in requests) / (1000 - 90 * parts)) * 1.5


def test_schedules_that_have_no_room(spark):
    requests = spark.createDataFrame([(1, 90.0), (2, 1.0)], "id long, weight double")
    with pytest.raises(Exception, match="too heavy"):
        service.schedule(requests, 4, tokens=100).collect()
    with pytest.raises(ValueError, match="more calls"):
        service.schedule(requests, 4, calls=4)
    assert {r.start_s for r in service.schedule(requests, 4).collect()} == {0.0}
    assert service.schedule(requests.limit(0), 4, tokens=100).collect() == []


def test_pace():
    now, slept = [5.0], []
    pace = service.Pace(patience=100, clock=lambda: now[0], sleep=lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for start in (30.0, 30.0, 42.0, 50.0):
        pace.wait(start)
    assert slept == [12.0, 8.0]
    with pytest.raises(service.OutOfPatience):
        pace.wait(200.0)


def test_a_cut_reply_gets_more_room():
    rooms = []

    def call(text, room):
        rooms.append(room)
        if room < 7000:
            raise service.CutShort
        return text

    assert service.with_retries(call, reply=1000)("x") == "x" and rooms == [1000, 2000, 4000, 8000]
    with pytest.raises(service.CutShort):
        service.with_retries(lambda t, room: call(t, 1), reply=service.MOST_REPLY)("x")


def test_each_chunk_is_asked_once(spark, tmp_path):
    """However often both results are read."""
    docs = spark.createDataFrame([(1, "x@y " * 3000), (2, "bad word"), (3, "x@y " * 3000), (4, None)], "doc_id long, text string")

    def call(chunk):
        with open(tmp_path / "calls", "a") as f:
            f.write("call\n")
        if chunk.startswith("bad"):
            raise OSError("refused")
        return [w for w in chunk.split() if "@" in w], len(chunk.split()), 1

    proposals, calls = detect.chunked_service(docs, {"name": "s", "call": call, "partitions": 2})
    for _ in range(2):
        assert sorted(r.doc_id for r in proposals.collect()) == [1, 3]
        rows = calls.collect()
    assert len((tmp_path / "calls").read_text().split()) == len(rows) >= 3


def test_the_budget_ends_the_calls(spark):
    requests = spark.createDataFrame([(f"{i:03d}", "a b c") for i in range(60)], "id string, text string")
    rule = {"name": "s", "call": lambda t: ([t], 1000, 100), "prices": (1.0, 10.0), "budget": 0.02}  # a call costs 0.002
    rows = service.ask(requests, rule).orderBy("id").collect()
    assert [r.error for r in rows] == [None] * 10 + [service.SPENT] * 50
    rows = service.ask(requests, {**rule, "partitions": 3}).collect()
    made = sum(r.error is None for r in rows)
    assert 10 <= made <= 13 and len(rows) == 60  # each part's last call may go past its part


def test_analysis_asks_a_service_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "This is the mail of the man: ann@b.com and it is for you"), (2, "That is for the bob@c.com in the house, and this is ann@b.com")], "doc_id long, text string")

    def call(text):
        with open(tmp_path / "calls", "a") as f:
            f.write("call\n")
        return [w for w in text.split() if w.startswith("bob@") or (w.startswith("ann@") and "mail" in text)]

    proposed, status = processor.processor("text").analyse(docs, [{"kind": "service", "name": "s", "call": call}])
    assert {(r.doc_id, r.n_boxes) for r in status.collect()} == {(1, 1), (2, 1)}
    # a term is sought where it was proposed alone
    assert {(r.doc_id, r.term) for r in proposed.collect()} == {(1, "ann@b.com"), (2, "bob@c.com")}
    assert len((tmp_path / "calls").read_text().split()) == 2


def test_image_text_from_chunks_to_boxes(spark, tmp_path):
    box = lambda x: (float(x), 0.0, float(x + 9), 10.0)
    words = [(1, 0, "Mail", box(0)), (1, 1, "ann@b.com,", box(10)), (2, 0, "no", box(0)), (2, 1, "ann@b.com", box(10)), (2, 2, "here", box(20)), (3, 0, "Mail", box(0)), (3, 1, "ann@b.com,", box(10)), (4, 0, "lost", box(0)), (5, 0, "ANN@B.COM", box(0))]
    seen = spark.createDataFrame(words, "image_id int, at int, text string, box struct<x0:double,y0:double,x1:double,y1:double>")
    shown = spark.createDataFrame([(i, 50, 20, "timeout" if i == 4 else None) for i in range(1, 7)], "image_id int, width int, height int, error string")

    def call(chunk):
        with open(tmp_path / "calls", "a") as f:
            f.write("call\n")
        return ["ann@b.com"] if chunk.startswith("Mail") else [], 1, 1

    rule = {"kind": "image_text", "name": "t", "call": call}
    boxes, calls = images.image_text(shown, seen, rule)
    # the string that one image's text gave is found in all that have it, as it is written
    assert {(r.image_id, r.name, r.box.x0, r.box.x1) for r in boxes.collect()} == {(1, "ann@b.com", 10.0, 19.0), (2, "ann@b.com", 10.0, 19.0), (3, "ann@b.com", 10.0, 19.0), (4, images.FAILED, 0.0, 50.0)}
    assert calls.count() == len((tmp_path / "calls").read_text().split()) == 3  # images 1 and 3 say the same
    faces = spark.createDataFrame([(1, (1.0, 1.0, 2.0, 2.0), None), (1, (1.0, 1.0, 2.0, 2.0), None)], "image_id int, box struct<x0:double,y0:double,x1:double,y1:double>, error string")
    signs = spark.createDataFrame([(2, None, "busy")], faces.schema)
    found = images.detect_in_images(shown, seen, [{"kind": "image", "name": "i", "faces": faces, "signatures": signs}, {"kind": "image_plate", "name": "p"}, rule])
    assert {(r.image_id, r.rule_name, r.name) for r in found.filter("rule_name <> 't'").collect()} == {(1, "i", "Face Detected"), (2, "i", "Signature Detection Failed"), (4, "p", images.FAILED)}
    assert found.filter("rule_name = 'i'").count() == 2
    with pytest.raises(ValueError):
        images.detect_in_images(shown, seen, [{"kind": "none", "name": "x"}])


def test_chunks_and_calls_are_made_as_they_are_asked_for(spark, monkeypatch):
    """Of a batch of texts few are cut before the first chunks leave the task."""
    import pyarrow as pa

    from inkveil.operators import detect

    docs = spark.range(1000).coalesce(1).selectExpr("id AS doc_id", "concat('a', id, ' b@', id) AS text")
    held = {}
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: held.setdefault("run", run))
    detect.chunks(docs)
    monkeypatch.undo()
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": [f"a{i} b@{i}" for i in range(1000)]})
    made = list(held["run"](iter([batch])))
    assert max(b.num_rows for b in made) <= 64 and sum(b.num_rows for b in made) == 1000
    rows, calls = detect.chunked_service(docs, {"name": "s", "call": lambda c: ([c.split("b@")[1]], 2, 1)})
    assert (rows.count(), calls.filter("error IS NULL AND n_terms = 1").count()) == (1000, 1000)
