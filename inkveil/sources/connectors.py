"""Storage connectors: reading whole objects and listings, writing without overwriting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import objects

_KINDS: dict[str, Callable[..., Connector]] = {}


class Connector:
    """Objects below a root folder that Spark can read: one row an object."""

    kind = ""

    def __init__(self, spark: SparkSession, root: str):
        if not root:
            raise ValueError("a root folder is needed")
        self.spark, self.root = spark, root.rstrip("/")

    def __init_subclass__(cls):
        if cls.kind in _KINDS:
            raise ValueError(f"kind {cls.kind} is registered already")
        _KINDS[cls.kind] = cls

    def read(self, glob: str = "*") -> DataFrame:
        """(path, name, created, n_bytes, content) of the objects that fit."""
        rows = self.spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(self.root)
        return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("created"), F.col("length").alias("n_bytes"), "content")

    def listing(self, prefix: str = "") -> DataFrame:
        """(name, folder, created, n_bytes) of the objects below the root whose path there begins with
        the prefix; only folders that can have such are listed, and no content is read."""
        objects.register(self.spark)
        return self.spark.read.format("objects").load(self.root).filter(F.col("name").startswith(prefix))

    def write(self, df: DataFrame, folder: str, fmt: str = "parquet", by: tuple[str, ...] = ()) -> str:
        """Write below the root; it is an error if the folder exists."""
        path = f"{self.root}/{folder}"
        writer = df.write.mode("errorifexists").format(fmt)
        (writer.partitionBy(*by) if by else writer).save(path)
        return path


class FileConnector(Connector):
    """A folder of any file system that Spark is set up for."""

    kind = "file"


def connector(kind: str, spark: SparkSession, root: str) -> Connector:
    """The connector of a kind; unknown kinds are an error."""
    if kind not in _KINDS:
        raise ValueError(f"no connector for {kind}; known are {', '.join(sorted(_KINDS))}")
    return _KINDS[kind](spark, root)


def endpoint(name: str | None = None, url: str | None = None, pattern: str = "https://{name}.store.example") -> str:
    """A store's address from exactly one of its name, put into the provider's pattern, and its address."""
    if (name is None) == (url is None):
        raise ValueError("give either a name or an address")
    return url if url is not None else pattern.format(name=name)


def json_lines(df: DataFrame, path: str) -> None:
    """Rows as JSON, a line each: UTF-8, other letters kept, times in ISO 8601; an existing folder is an error."""
    columns = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias(c) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes]
    df.select(F.to_json(F.struct(*columns)).alias("value")).write.mode("errorifexists").text(path)


def yaml_config(text: str) -> str:
    """A YAML configuration as the JSON that rules are flattened from."""
    import json

    import yaml

    loaded = yaml.safe_load(text)
    if not isinstance(loaded, dict) or "redactors" not in loaded:
        raise ValueError("a configuration has redactors")
    return json.dumps(loaded)
