"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_open: list[list[str]] = []
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Spark's setting (4.1 and later) that frees a query's shuffle files when it ends.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. On a local master, where it may be unset, a temporary one; on a cluster that would be a folder of one machine, so it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return _local[app]


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and run inside leave no shuffle files. Else those stay until the driver's JVM happens to collect its garbage, by which time a large input may have filled the disk."""
    was = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(_FREED)
        else:
            spark.conf.set(_FREED, was)


def stash(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, so that a lost executor costs a read and not the work before it.

    The caller's frame reads the tables lazily, so they stay until the folder is cleared, until scratch() ends, or until
    unstash() is called. What was shuffled to make them goes at once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stash-{uuid.uuid4().hex}"
    with freed(spark):
        df.write.parquet(path)
    for paths in _open[-1:]:
        paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def unstash(*tables: DataFrame) -> None:
    """Deletes the tables of frames that stash() returned, once nothing that is still to run reads them."""
    for table in tables:
        _delete(table.sparkSession, _paths.pop(table))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that were stashed inside; results must be written before it ends."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            _delete(spark, path)
