"""A job's artefacts by stage, committed in two steps: whole versions, the last one named by a manifest."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The artefacts that stages leave, by the stage's name.
STAGES = {"ANALYSE": ("raw", "proposed"), "REDACT": ("curated", "redacted"), "SANITISE": ("sanitised",)}


class Artefacts:
    """The folder of a job: `<stage>/<artefact>` as versions of Parquet, and numbered manifests, the last of which counts.

    A stage writes all its artefacts into folders of a new version and then, last, a manifest,
    which is moved into place whole. Readers follow the manifest: a stage that ends between,
    or runs again, leaves the version before as it was, and versions are never mixed.
    """

    def __init__(self, spark: SparkSession, root: str, job_id: str):
        self.spark, self.folder = spark, f"{root.rstrip('/')}/{job_id}"
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _text(self, path: str) -> str | None:
        if not self._fs.exists(self._path(path)):
            return None
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _put(self, path: str, text: str) -> None:
        passing = f"{path}.{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(passing))
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self._fs.rename(self._path(passing), self._path(path)):
            raise OSError(f"{path} could not be put into place")

    def stage(self, stage: str, version: str | None = None, **artefacts: DataFrame) -> str:
        """Write a stage's artefacts to a new version, not yet seen by readers; the version's name."""
        known = STAGES.get(stage)
        if known is None or not {*artefacts} <= {*known, "log", "metrics", "exceptions"}:
            raise ValueError(f"stage {stage} has {', '.join(known or ())}, not {', '.join(artefacts)}")
        version = version or uuid.uuid4().hex
        for name, rows in artefacts.items():
            rows.write.mode("overwrite").parquet(f"{self.folder}/{stage}/{version}/{name}")
        return version

    def commit(self, stage: str, version: str) -> None:
        """Make a version the stage's, by the next manifest; those before stay."""
        held = self._manifest(stage)
        number = held["number"] + 1 if held else 0
        self._put(f"{self.folder}/{stage}/manifest-{number:09d}.json", json.dumps({"version": version, "number": number}))

    def save(self, stage: str, **artefacts: DataFrame) -> None:
        """Both steps."""
        self.commit(stage, self.stage(stage, **artefacts))

    def _manifest(self, stage: str) -> dict | None:
        folder = self._path(f"{self.folder}/{stage}")
        if not self._fs.exists(folder):
            return None
        names = sorted(n for s in self._fs.listStatus(folder) if (n := s.getPath().getName()).startswith("manifest-") and n.endswith(".json"))
        return json.loads(self._text(f"{self.folder}/{stage}/{names[-1]}")) if names else None

    def read(self, stage: str, artefact: str) -> DataFrame:
        """An artefact of the stage's last committed version."""
        held = self._manifest(stage)
        if held is None:
            raise FileNotFoundError(f"{stage} has committed nothing in {self.folder}")
        return self.spark.read.parquet(f"{self.folder}/{stage}/{held['version']}/{artefact}")
