"""A message queue in a folder, as a stream source and a stream sink.

A writer's batch is one segment: its tasks write parts of JSON lines, and the commit puts a
manifest that names them, last. What no manifest names is not there. A segment's name is its
writer, its batch, the number of its first message among the writer's and how many it has, so
that positions are told from names alone. A batch that is written again finds its manifest and
gives up its parts: nothing is there twice.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

from . import stores

COLUMNS = "id string, expires timestamp, value string"


@dataclass
class Segment:
    path: str
    batch: int
    first: int
    count: int


def segments(system, root: str, writer: str) -> list[Segment]:
    """A writer's segments in order."""
    out = []
    for x in stores.children(system, f"{root}/log/{writer}"):
        name = x.path.rpartition("/")[2]
        if name.endswith(".json") and not name.startswith("."):
            out.append(Segment(x.path, *map(int, name[: -len(".json")].split("-"))))
    return out


def writers(system, root: str) -> list[str]:
    return [x.path.rpartition("/")[2] for x in stores.children(system, f"{root}/log")]


@dataclass
class Part(WriterCommitMessage):
    path: str
    count: int


class QueueWriter(DataSourceStreamWriter):
    def __init__(self, options):
        self.root, self.writer = options["path"], options.get("writer", "writer")

    def write(self, rows: Iterator[Row]) -> Part:
        system, root = stores.at(self.root)
        line = lambda r: json.dumps({"id": r["id"], "expires": None if r["expires"] is None else r["expires"].timestamp(), "value": r["value"]}, ensure_ascii=False)
        path = f"{root}/parts/{self.writer}-{uuid.uuid4().hex}.jsonl"
        return Part(path, stores.put_lines(system, path, (f"{line(r)}\n".encode() for r in rows)))

    def commit(self, messages: list[Part | None], batchId: int) -> None:
        system, root = stores.at(self.root)
        held = segments(system, root, self.writer)
        if any(s.batch == batchId for s in held):  # a batch that is run again
            return self.abort(messages, batchId)
        parts = [m for m in messages if m is not None and m.count]
        first, count = (held[-1].first + held[-1].count if held else 0), sum(p.count for p in parts)
        body = json.dumps([[p.path.rpartition("/")[2], p.count] for p in parts])
        stores.put(system, f"{root}/log/{self.writer}/{batchId:012d}-{first}-{count}.json", body.encode())

    def abort(self, messages: list[Part | None], batchId: int) -> None:
        system, _ = stores.at(self.root)
        for m in messages:
            if m is not None and m.count:
                system.delete_file(m.path)


class Slice(InputPartition):
    """Messages of a part: so many after the first ones."""

    def __init__(self, path: str, skip: int, take: int):
        self.path, self.skip, self.take = path, skip, take


class QueueReader(DataSourceStreamReader):
    """Offsets are a number of messages a writer. At most `limit` messages make a batch: where the
    last planned batch ended is kept beside the queue under the reader's name, as the engine
    tells it only when it plans."""

    def __init__(self, options):
        self.root, self.reader = options["path"], options.get("reader", "reader")
        self.limit = int(options["limit"]) if "limit" in options else None

    def _place(self, root: str) -> str:
        return f"{root}/readers/{self.reader}.json"

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, root = stores.at(self.root)
        place = self._place(root)
        planned = json.loads(stores.content(system, place)) if system.get_file_info(place).is_file else {}
        out, room = dict(planned), self.limit
        for writer in writers(system, root):
            held = segments(system, root, writer)
            end, at = held[-1].first + held[-1].count if held else 0, planned.get(writer, 0)
            step = end - at if room is None else min(room, end - at)
            if step > 0:
                out[writer] = at + step
                room = None if room is None else room - step
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        system, root = stores.at(self.root)
        stores.put(system, self._place(root), json.dumps(end).encode())
        out = []
        for writer, to in end.items():
            since = start.get(writer, 0)
            for s in segments(system, root, writer):
                at = s.first
                if at >= to or at + s.count <= since:
                    continue
                for name, count in json.loads(stores.content(system, s.path)):
                    low, high = max(since, at), min(to, at + count)
                    if low < high:
                        out.append(Slice(f"{root}/parts/{name}", low - at, high - low))
                    at += count
        return out

    def read(self, partition: Slice) -> Iterator[tuple]:
        from datetime import UTC, datetime

        system, _ = stores.at(self.root)
        for line in islice(stores.lines(system, partition.path), partition.skip, partition.skip + partition.take):
            row = json.loads(line)
            yield row["id"], None if row["expires"] is None else datetime.fromtimestamp(row["expires"], UTC), row["value"]


class QueueSource(DataSource):
    """`path` is the queue's folder; `reader` and `limit` are a reader's name and its messages a
    batch, `writer` a writer's name. Those who read, or write, at once have names of their own."""

    @classmethod
    def name(cls) -> str:
        return "queue"

    def schema(self) -> str:
        return COLUMNS

    def streamReader(self, schema) -> DataSourceStreamReader:
        return QueueReader(self.options)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return QueueWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make `format("queue")` known to streams."""
    spark.dataSource.register(QueueSource)
