"""Staged tables: results that several later passes read, written once to shared storage."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tallyspark-")


def staging_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves a session whose tasks run in this process;
    on a cluster each machine would write to a disk of its own, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return _own_folder()
    raise ValueError("set spark.checkpoint.dir to a folder that all machines share")


def staging_path(spark: SparkSession, name: str) -> str:
    """A new folder under the staging root."""
    return f"{staging_root(spark).rstrip('/')}/tallyspark/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the staging root (or to ``path``, made for it) and read it back.

    Cuts the lineage, survives the loss of executors, and lets each later pass prune
    columns.
    """
    spark = df.sparkSession
    path = path or staging_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession, path: str) -> None:
    """Delete a staged table, made at a ``staging_path``, that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
