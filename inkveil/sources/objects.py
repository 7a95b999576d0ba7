"""Listings of stored objects as a data source: (name, folder, created, n_bytes), contents unread."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringStartsWith

from . import stores

COLUMNS = "name string, folder string, created timestamp, n_bytes long"
_SCHEMA = pa.schema([("name", pa.string()), ("folder", pa.string()), ("created", pa.timestamp("us", tz="UTC")), ("n_bytes", pa.int64())])


class Folders(InputPartition):
    """Entries below the root that one task lists, and the prefix that names have."""

    def __init__(self, entries: list[str], prefix: str):
        self.entries, self.prefix = entries, prefix


class ObjectsReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.parts = options["path"], int(options.get("parts", "64"))
        self.prefix = options.get("prefix", "")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """The beginning of a name, or the whole of it, cuts the listing; the rest is Spark's."""
        for f in filters:
            if isinstance(f, (StringStartsWith, EqualTo)) and f.attribute == ("name",) and isinstance(f.value, str):
                longer, shorter = (f.value, self.prefix) if len(f.value) >= len(self.prefix) else (self.prefix, f.value)
                # of two beginnings that disagree nothing is left, which the filter itself tells
                self.prefix = longer if longer.startswith(shorter) else self.prefix
            yield f

    def partitions(self) -> list[InputPartition]:
        """The entries of the folder in which the prefix ends, those that go on with it, dealt out."""
        system, root = stores.at(self.root)
        inner = self.prefix.rpartition("/")[0]
        found = [x.path for x in stores.children(system, f"{root}/{inner}" if inner else root) if x.path[len(root) + 1 :].startswith(self.prefix)]
        return [Folders(found[i :: self.parts], self.prefix) for i in range(min(self.parts, len(found)))] or [Folders([], self.prefix)]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        system, root = stores.at(self.root)
        for entry in partition.entries:
            info = system.get_file_info(entry)
            infos = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(entry, recursive=True))
            files = [x for x in infos if x.type == fs.FileType.File and x.path[len(root) + 1 :].startswith(partition.prefix)]
            names = [x.path[len(root) + 1 :] for x in files]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([n.rpartition("/")[0] for n in names], pa.string()), pa.array([x.mtime for x in files], _SCHEMA.field("created").type), pa.array([x.size for x in files], pa.int64())], schema=_SCHEMA)


class ObjectsSource(DataSource):
    """`path` is the root; `parts` tasks at most list it; `prefix` is a beginning that all names have."""

    @classmethod
    def name(cls) -> str:
        return "objects"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return ObjectsReader(self.options)


def register(spark: SparkSession) -> None:
    """Make `spark.read.format("objects")` known, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ObjectsSource)
