"""Files that tasks write to and read from the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession

from ..plans.staging import staging_root


def shared_folder(spark: SparkSession, name: str) -> str:
    """The URI of a new folder under ``spark.checkpoint.dir``; the first writer creates it."""
    return f"{staging_root(spark).rstrip('/')}/tallyspark/{name}-{uuid.uuid4().hex}"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI; local files are memory-mapped."""
    system, path = fs.FileSystem.from_uri(uri)
    return (fs.LocalFileSystem(use_mmap=True), path) if isinstance(system, fs.LocalFileSystem) else (system, path)


def attempt_name(stem: str) -> str:
    """A file name that no other attempt of this task uses.

    A retried or speculative attempt writes files of its own; the table of names that the
    winning attempt returns is what counts, files of lost attempts are never read.
    """
    context = TaskContext.get()
    return f"{stem}-{context.partitionId():06d}-{context.taskAttemptId()}"
