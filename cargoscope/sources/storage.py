"""Folders of the shared store: finished versions by name, listing, removal.

Paths go through Hadoop's file system classes, so any store that Spark reads
works; nothing here opens a local file.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _fs(spark, path)
    return fs.exists(where)


def children(spark: SparkSession, path: str) -> dict[str, int]:
    """Name -> modification time in ms of what lies directly under a folder
    (nothing where there is no such folder)."""
    where, fs = _fs(spark, path)
    if not fs.exists(where):
        return {}
    return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(where)}


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _fs(spark, path)
    fs.delete(where, True)


def newest_version(spark: SparkSession, path: str) -> int:
    """The greatest published version of the table at ``path``; 0 if none."""
    if not exists(spark, f"{path}/versions"):
        return 0
    return spark.read.schema("version long").json(f"{path}/versions").agg(
        F.max("version").alias("v")).first()["v"] or 0


def publish_version(spark: SparkSession, path: str, version: int) -> None:
    """Names a version once it is whole: one appended file, in one step."""
    spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").json(
        f"{path}/versions")
