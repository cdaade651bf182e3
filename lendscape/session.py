"""Session settings the jobs rely on, and the shared folder they may write to."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot join key is split even where that costs a later join one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Repairs cost far more per byte than Spark assumes, so small stages keep their parallelism.
    # Large ones are unaffected: there a task's share of the data is above this floor anyway.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    # Re-running a month replaces that month only.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def no_shuffle_kept(spark: SparkSession) -> Iterator[None]:
    """What is run here removes its shuffle files when it ends.

    Else they stay until the driver's collector finds their plan unused, and a job of many writes holds them all at once.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names for intermediate data: ``spark.checkpoint.dir``, else its warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch").rstrip("/")


class Workspace:
    """A job's own folder below the shared one. What it stores is its own, and so is what it removes.

    ``store`` writes an intermediate result and reads it back: it is computed once, branches that
    read it cannot disagree, and a lost executor costs a read instead of the whole lineage.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def store(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.folder(name))
        return self.spark.read.schema(df.schema).parquet(self.folder(name))

    def drop(self, *names: str) -> None:
        """Remove single results that nothing reads any more."""
        for name in names:
            self._delete(self.folder(name))

    def remove(self) -> None:
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


_CURRENT: ContextVar[Workspace | None] = ContextVar("workspace", default=None)
_LOOSE: dict[str, Workspace] = {}


def _workspace(spark: SparkSession) -> Workspace:
    """That of the job in whose ``scratch`` block the caller is, else the session's."""
    current = _CURRENT.get()
    if current is not None:
        return current
    return _LOOSE.setdefault(spark.sparkContext.applicationId, Workspace(spark, "session"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result to the job's folder and read it back.

    For results that several branches of a job use. ``scratch`` removes what its job has stored,
    ``drop_stored`` what was stored outside any.
    """
    return _workspace(df.sparkSession).store(df, f"{name}-{uuid.uuid4().hex}")


def drop_stored(spark: SparkSession) -> None:
    """Remove what was stored outside any ``scratch`` block."""
    loose = _LOOSE.pop(spark.sparkContext.applicationId, None)
    if loose is not None:
        loose.remove()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Workspace]:
    """A job whose result no longer needs what it stored on the way. Other jobs' results are not touched."""
    own, before = Workspace(spark, "job"), _CURRENT.get()
    _CURRENT.set(own)
    try:
        yield own
    finally:
        if _CURRENT.get() is own:
            _CURRENT.set(before)
        own.remove()


@contextmanager
def outliving(spark: SparkSession) -> Iterator[None]:
    """Inside a ``scratch`` block: what is stored here stays until ``drop_stored``."""
    before = _CURRENT.get()
    _CURRENT.set(None)
    try:
        yield
    finally:
        _CURRENT.set(before)
