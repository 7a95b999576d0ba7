"""Results that are computed once and kept where the driver and all executors read them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, set from spark.checkpoint.dir. Where that is unset,
    a folder of this machine serves a local session, as in tests; on a cluster it is an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """Compute df once, now, into the shared folder and cut its lineage there: what asks a
    service, or is read more than once, is not asked or worked out again."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
