"""Listings, the queue as a stream, and artefacts in two steps."""

import json

import pytest
from pyspark.sql import functions as F

from inkveil.sources import artefacts, connectors, objects, queue
from inkveil.streaming import jobs


def tree(root, names):
    for name in names:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)


NAMES = ["job1-1/raw.json", "job1-1/deep/er/x.json", "job12-1/raw.json", "job2/raw.json", "top.json", "jöb [1]/a b.json"]


def test_listing_cuts_to_the_prefix(spark, tmp_path):
    tree(tmp_path, NAMES)
    store = connectors.connector("file", spark, str(tmp_path))
    for prefix in ("", "job1", "job1-1/", "job1-1/deep/er/", "t", "jöb [", "none", "job1-1/raw.json"):
        rows = store.listing(prefix).collect()
        assert sorted(r.name for r in rows) == sorted(n for n in NAMES if n.startswith(prefix)), prefix
    sized = {r.name: (r.folder, r.n_bytes) for r in spark.read.format("objects").load(str(tmp_path)).collect()}
    assert sized["job1-1/deep/er/x.json"] == ("job1-1/deep/er", len("job1-1/deep/er/x.json"))


def test_listing_does_not_touch_other_folders(spark, tmp_path):
    tree(tmp_path, NAMES)
    (tmp_path / "job9").mkdir()
    reader = objects.ObjectsReader({"path": str(tmp_path)})
    kept = list(reader.pushFilters([objects.StringStartsWith(("name",), "job1-1/deep"), objects.StringStartsWith(("name",), "job1"), objects.EqualTo(("folder",), "x")]))
    assert len(kept) == 3 and reader.prefix == "job1-1/deep"
    assert [e.rsplit("/", 1)[1] for p in reader.partitions() for e in p.entries] == ["deep"]
    objects.register(spark)
    plan = spark.read.format("objects").load(str(tmp_path)).filter(F.col("name").startswith("job1-1/"))
    assert sorted(r.name for r in plan.collect()) == ["job1-1/deep/er/x.json", "job1-1/raw.json"]


def sent(spark, path, writer, rows, checkpoint):
    """Messages from a folder of files into the queue, once."""
    messages = spark.readStream.schema(queue.COLUMNS).parquet(rows)
    messages.writeStream.format("queue").option("path", path).option("writer", writer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def taken(spark, path, limit, checkpoint, out, reader="r"):
    """One batch of the queue into a folder; how many rows it had."""
    got = []

    def put(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        got.append(batch.count())

    stream = spark.readStream.format("queue").option("path", path).option("reader", reader).option("limit", limit).load()
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return got


def test_queue_loses_and_doubles_nothing_over_restarts(spark, tmp_path):
    queue.register(spark)
    path, rows = f"file://{tmp_path}/queue", str(tmp_path / "rows")
    message = lambda a, b: spark.range(a, b).select(F.col("id").cast("string"), F.timestamp_seconds(F.lit(1_700_000_000.25)).alias("expires"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("ä\n"), F.col("id").cast("string"))).alias("value"))
    message(0, 37).repartition(4).write.parquet(rows)
    sent(spark, path, "a", rows, str(tmp_path / "ca"))
    sizes = [n for _ in range(2) for n in taken(spark, path, 16, str(tmp_path / "cr"), str(tmp_path / "out"))]
    assert sizes == [16, 16]
    # more messages, of two writers, while the reader is away
    message(37, 50).write.mode("append").parquet(rows)
    sent(spark, path, "a", rows, str(tmp_path / "ca"))
    sent(spark, path, "b", rows, str(tmp_path / "cb"))
    while more := taken(spark, path, 16, str(tmp_path / "cr"), str(tmp_path / "out")):
        sizes += more
    assert sum(sizes) == 100 and max(sizes) == 16
    got = sorted((int(r.id), r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((i, f"ä\n{i}" if i % 5 else None) for i in range(50) for _ in range(2))
    assert spark.read.parquet(str(tmp_path / "out")).select(F.unix_micros("expires")).distinct().collect()[0][0] == 1_700_000_000_250_000


def test_a_batch_that_is_run_again(spark, tmp_path):
    """A reader that died after planning, and a writer that died before or after its commit."""
    path = str(tmp_path / "queue")
    row = lambda i: {"id": str(i), "expires": None, "value": "v"}
    writer = queue.QueueWriter({"path": path})
    lost = writer.write(iter([row(0)]))  # never committed: a task that was lost
    first = writer.write(iter([row(1), row(2)]))
    writer.commit([first, None, writer.write(iter([]))], 0)
    again = writer.write(iter([row(1), row(2)]))
    writer.commit([again], 0)
    writer.commit([writer.write(iter([row(3)]))], 1)
    aborted = writer.write(iter([row(9)]))
    writer.abort([aborted, None], 2)
    left = sorted(p.name for p in (tmp_path / "queue/parts").iterdir())
    assert len(left) == 3 and lost.path.rsplit("/", 1)[1] in left
    reader = queue.QueueReader({"path": path, "limit": "2"})
    end = reader.latestOffset()
    read = lambda a, b: [r[0] for p in reader.partitions(a, b) for r in reader.read(p)]
    assert read({}, end) == ["1", "2"]
    # planned and then lost: a new reader plans the same again, and goes on from there
    reader = queue.QueueReader({"path": path, "limit": "2"})
    assert read({}, end) == ["1", "2"] and read(end, reader.latestOffset()) == ["3"]
    assert reader.latestOffset() == {"writer": 3} and reader.initialOffset() == {}


def test_ids_of_messages_are_stable(spark):
    from inkveil.operators.jobs import queue_messages

    rows = spark.createDataFrame([('{"a":"1"}', 5), ('{"a":"1"}', 6), ('{"overrideId":"x"}', 5), ("{bad", 5)], "body string, s long").select("body", F.timestamp_seconds("s").alias("ts"))
    ids = [sorted(r.id for r in queue_messages(rows, F.lit("ANALYSE")).collect()) for _ in range(2)]
    assert ids[0] == ids[1] and len({*ids[0]}) == 3 and "x" in ids[0]


def test_a_stage_that_ends_between_leaves_the_version_before(spark, tmp_path):
    held = artefacts.Artefacts(spark, str(tmp_path), "job-1")
    with pytest.raises(FileNotFoundError):
        held.read("ANALYSE", "raw")
    one, two = spark.range(3), spark.range(5)
    held.save("ANALYSE", raw=one, proposed=one, metrics=one)
    version = held.stage("ANALYSE", raw=two, proposed=two)  # and then the driver is lost
    assert held.read("ANALYSE", "raw").count() == held.read("ANALYSE", "proposed").count() == 3
    again = artefacts.Artefacts(spark, str(tmp_path), "job-1")
    again.commit("ANALYSE", version)
    assert again.read("ANALYSE", "raw").count() == again.read("ANALYSE", "proposed").count() == 5
    with pytest.raises(ValueError):
        held.stage("ANALYSE", redacted=one)
    with pytest.raises(ValueError):
        held.stage("OTHER", raw=one)
    assert json.loads((tmp_path / "job-1/ANALYSE/manifest-000000001.json").read_text())["version"] == version


def test_file_queue_takes_so_many_files_a_batch(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.json").write_text(json.dumps({"job_id": str(i)}))
    stream = jobs.file_queue(spark, str(tmp_path), "job_id string", files=2)
    sizes = []
    stream.writeStream.foreachBatch(lambda b, _: sizes.append(b.count())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sizes == [2, 2, 1]


def test_lines_are_written_and_read_as_they_come(tmp_path):
    """A part of the queue is not held whole: lines are made while earlier ones are written, and read one by one."""
    from inkveil.sources import stores

    system, root = stores.at(str(tmp_path))
    texts = ["a", "", "b\u2028c\x85d\re", "Ünal"] * 1000
    assert stores.put_lines(system, f"{root}/d/x.jsonl", (f"{t}\n".encode() for t in texts)) == 4000
    assert list(stores.lines(system, f"{root}/d/x.jsonl", held=64)) == texts

    def failing():
        yield b"a"
        raise ValueError

    with pytest.raises(ValueError):
        stores.put_lines(system, f"{root}/d/y.jsonl", failing())
    assert stores.put_lines(system, f"{root}/d/z.jsonl", iter([])) == 0
    assert [x.path.rpartition("/")[2] for x in stores.children(system, f"{root}/d")] == ["x.jsonl"]
