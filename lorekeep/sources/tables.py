"""Tables that outlive a plan: written once to the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


#: Folders that this application has made for one use each.
_MADE: list[str] = []


def _top(spark: SparkSession) -> str:
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(top)
    return top.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A new path below the folder that the cluster names in spark.checkpoint.dir. Where that is unset a local folder is made, but only if driver and executors are one process."""
    _MADE.append(f"{_top(spark)}/lorekeep-{uuid.uuid4().hex}")
    return _MADE[-1]


def saved(df: DataFrame) -> str:
    """Write df to a new path in the shared folder and return the path."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return path


def stash(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: lineage is cut, and a lost executor loses nothing."""
    return df.sparkSession.read.schema(df.schema).parquet(saved(df))


def _files(spark: SparkSession, path: str):
    """The store of a path, and the path as that store has it."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    store, found = _files(spark, path)
    return store.exists(found)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a kept table or folder."""
    store, found = _files(spark, path)
    store.delete(found, True)


def release(spark: SparkSession) -> None:
    """Delete the tables that this application has written for one use, when no DataFrame that reads them is needed any more. Kept tables stay."""
    while _MADE:
        drop(spark, _MADE.pop())


def version(df: DataFrame) -> tuple:
    """The files that df reads, with their sizes and times, as the store lists them: another version of a table has another. No row is read."""
    found = []
    for path in sorted(df.inputFiles()):
        store, at = _files(df.sparkSession, path)
        status = store.getFileStatus(at)
        found.append((path, status.getLen(), status.getModificationTime()))
    return tuple(found)


def kept_path(spark: SparkSession, name: str, source: DataFrame) -> str:
    """Where what is derived from this version of source under a name is kept. Another application with the same spark.checkpoint.dir finds the same path."""
    return f"{_top(spark)}/lorekeep-kept-{hashlib.sha256(repr((name, version(source))).encode()).hexdigest()[:32]}"


def maintained(name: str, source: DataFrame, make: Callable[[], DataFrame]) -> DataFrame:
    """A derived table: made when first asked for, found again by later applications, and made anew when the files of its source change. One writer at a time."""
    spark = source.sparkSession
    path = kept_path(spark, name, source)
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
