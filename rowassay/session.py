"""Session settings and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "rowassay", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder the cluster names."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or where the context keeps checkpoints.

    Only a session of one local process may go without: it gets a folder that goes with it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if spark.sparkContext.master.split("[")[0] == "local":
            return _own_folder().name
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return folder


@lru_cache(maxsize=1)
def _own_folder() -> tempfile.TemporaryDirectory:
    """Deleted when the process ends."""
    return tempfile.TemporaryDirectory(prefix="rowassay-", ignore_cleanup_errors=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, where every executor can write."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
