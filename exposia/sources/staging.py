"""Written stages that cut lineage, kept in the shared folder the session names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_FOLDER = "spark.checkpoint.dir"
_SCOPE: ContextVar[str] = ContextVar("scope", default="")


def _root(spark: SparkSession) -> str:
    """The folder for stages; only a local session may fall back to a temp folder,
    which goes when the process ends."""
    context = spark.sparkContext
    root = spark.conf.get(_FOLDER, None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError(f"set {_FOLDER} to a folder that every executor can reach")
        own = tempfile.mkdtemp(prefix="exposia-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(own)
        root = context.getCheckpointDir()
    return f"{root.rstrip('/')}/exposia/{context.applicationId}{_SCOPE.get()}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path among the stages of this application."""
    return f"{_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write a frame as parquet and read it back.

    What follows reads columnar files instead of recomputing the plan, lost executors cost only
    their tasks, and Catalyst knows the real size. The files stay unless written under :func:`stages`.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def stages(spark: SparkSession) -> Iterator[None]:
    """Stages written within go at the end, also after an error: for jobs whose result is written
    elsewhere. Frames that read them break then."""
    token = _SCOPE.set(f"{_SCOPE.get()}/{uuid.uuid4().hex}")
    try:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_root(spark))
        yield
    finally:
        _SCOPE.reset(token)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
