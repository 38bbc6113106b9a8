"""The folder that the driver and all executors share, for tables that several branches of a plan read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .config import UserFacingError

_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session (tests) gets a temporary folder; a cluster has no folder that all would see, which is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/palaver"
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise UserFacingError("no_shared_folder", "Set spark.checkpoint.dir to a folder that the driver and all executors share.")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="palaver-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def write_shared(df: DataFrame, name: str) -> str:
    """df written to the shared folder: its path, for remove."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once and read back: what it costs is paid once, columns that a branch doesn't use aren't read, and a lost executor loses nothing."""
    return df.sparkSession.read.schema(df.schema).parquet(write_shared(df, name))


def release_shuffles(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of finished jobs when the driver's garbage is collected, which a driver with little to do seldom is."""
    spark._jvm.System.gc()


def _opened(spark: SparkSession, path: str):
    """The file system of a path, and the path for it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    files, where = _opened(spark, path)
    files.delete(where, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    files, where = _opened(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(where))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, wherever Spark can write."""
    files, where = _opened(spark, path)
    out = files.create(where, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def clear(spark: SparkSession) -> None:
    """Delete what this package has left in the shared folder. Tables that were made before can't be read any more."""
    remove(spark, shared_folder(spark))
