"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Start wide and let AQE merge small shuffle partitions at run time.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "4096",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def build_session(app_name: str = "sparkdesk", **overrides: str) -> SparkSession:
    """Session with the settings above, changed by ``**{"spark.some.key": "value"}``."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Throw-away folders of local sessions that name none.
_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the session's ``spark.checkpoint.dir``.

    A throw-away folder of this machine stands in only in local mode.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="sparkdesk-")
    return _LOCAL_DIRS[app]


def work_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/sparkdesk/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` once to the shared folder and read it back.

    Later stages re-read columns of a table instead of recomputing text features,
    also after an executor is lost.
    """
    path = work_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _hadoop_path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def remove_path(spark: SparkSession, path: str) -> None:
    target, files = _hadoop_path(spark, path)
    files.delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    target, files = _hadoop_path(spark, path)
    return files.exists(target)


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs planned and run within leave no shuffle files, so repeated passes don't add up."""
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Plans made within hand batches of up to 16 MB to Python, which both sides hold at once."""
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, str(16 << 20))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_BYTES)
        else:
            spark.conf.set(BATCH_BYTES, before)


@contextmanager
def kept_near(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` in the executors' memory, or on their disks, for repeated passes over it.

    What a lost executor held is read again from where ``df`` comes from.
    """
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist(blocking=True)


@contextmanager
def written(df: DataFrame, tag: str) -> Iterator[DataFrame]:
    """``materialize`` for the length of a block; the table goes even if the block fails."""
    table, path = materialize(df, tag)
    try:
        yield table
    finally:
        remove_path(df.sparkSession, path)
